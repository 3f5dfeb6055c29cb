"""Skew paths give the rows a plain join gives."""

from pyspark.sql import functions as F

from varscope import session
from varscope.operators import joins, selection
from varscope.operators.joins import join_heavy, join_per_key


def table(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def skewed(spark):
    return spark.range(200_000).selectExpr("if(id % 2 = 0, 'hot', 'k' || id % 100) as key", "id")


def test_heavy_key_is_found_and_joined(spark):
    rows = skewed(spark)
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("none", 4)], ["key", "v"])
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert session.heavy_keys(counted, "n") == 1 << 16
    for how in ("inner", "left_anti"):
        got = join_heavy(rows, side, ["key"], counted, "n", how)
        want = rows.join(side, "key", how)
        assert got.count() == want.count()
        assert got.exceptAll(want.select(got.columns)).count() == 0


def test_heavy_side_of_much_text_is_not_broadcast(spark, monkeypatch):
    rows = skewed(spark)
    side = spark.createDataFrame([("hot", "x" * 1000), ("k1", "y"), ("none", "z")], ["key", "v"])
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    for how in ("inner", "left", "left_anti"):
        got = join_heavy(rows, side, ["key"], counted, "n", how)
        want = rows.join(side, "key", how)
        assert got.count() == want.count()
        assert got.select(want.columns).exceptAll(want).count() == 0
    assert joins.salts_for(rows) == joins.LEAST_SALTS


def test_no_heavy_key(spark):
    counted = spark.createDataFrame([("a", 5)], ["key", "n"])
    assert session.heavy_keys(counted, "n") is None


def test_threshold_rises_until_the_broadcast_is_small(spark):
    counted = spark.range(100).selectExpr("id as key", "if(id < 3, 1 << 20, 1 << 17) as n")
    assert session.heavy_keys(counted, "n", limit=10) == 1 << 20
    assert session.heavy_keys(counted, "n", limit=2) is None


def test_salted_join_equals_broadcast_join(spark):
    rows = skewed(spark).filter("id < 5000")
    side = spark.createDataFrame([("hot", 1), ("k1", 2)], ["key", "v"])
    assert table(join_per_key(rows, side, ["key"], ["id"], small=False)) == table(
        join_per_key(rows, side, ["key"], ["id"], small=True)
    )


def test_late_and_early_selection_agree(spark, files_of):
    texts = {f"{d}/f{n}.py": f'os.getenv("{d}_{n}")' for d in ("a", "gen", "b") for n in range(5)}
    files = files_of(texts).unionByName(files_of(texts, "s")).unionByName(files_of(texts, "t"))
    rules = spark.createDataFrame(
        [("r", "gitignore", 1, "gen/"), ("s", "exclude", 1, "f3.py")],
        "repo string, kind string, ord int, pattern string",
    )
    changes = spark.createDataFrame(
        [("r", "gen/f1.py", 2), ("r", "a/f0.py", 1), ("r", "gen/f1.py", 3), ("r", "no.py", 4)],
        "repo string, path string, ord bigint",
    )
    assert table(selection.walk_refs(files, rules, small=True)) == table(
        selection.walk_refs(files, rules, small=False)
    )
    early = selection.changed_or_walked_refs(files, changes, rules, small=True)
    late = selection.changed_or_walked_refs(files, changes, rules, small=False)
    assert table(early) == table(late)
    listed = [(r.pos.rank, r.path) for r in early.filter("repo = 'r'").orderBy("pos").collect()]
    assert listed == [(1, "a/f0.py"), (2, "gen/f1.py"), (3, "gen/f1.py")]
    assert early.filter("repo = 's'").count() == 12
    staged = selection.staged_refs(files, changes)
    assert table(staged) == table(early.filter("repo = 'r'").select(staged.columns))


def test_broadcasts_are_bounded():
    assert 1 < joins.LEAST_SALTS < joins.MOST_SALTS and session.BROADCAST_ROW_LIMIT <= 1_000_000
