"""Work is dealt to as many tasks as the input asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from varscope.operators import selection, stack
from varscope.operators.languages import PYTHON
from varscope.plans import corpus
from varscope.session import SPLIT_BYTES, tune
from varscope.streaming import alerts


def test_corpus_parts_grow_with_the_files(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FILES_PER_PART", 100)
    orders = spark.range(0, 5000, 1, 60).withColumnRenamed("id", "o_orderkey")
    # all rows in one of many splits
    crowded = orders.union(spark.range(5000, 9000, 1, 1).withColumnRenamed("id", "o_orderkey"))
    rendered = corpus.render(crowded)
    sizes = [row["count"] for row in rendered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 90
    assert max(sizes) <= 200
    assert rendered.select("k").distinct().count() == 9000


def test_splits_are_small_but_smaller_ones_stay(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "128m")
        tune(spark)
        assert int(spark.conf.get(name)) == SPLIT_BYTES
        spark.conf.set(name, "1m")
        tune(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_many_changes_are_chosen_before_their_text_is_read(spark, monkeypatch):
    monkeypatch.setattr(selection, "fits_broadcast", lambda df: False)
    seen = []
    extract = selection.extract
    monkeypatch.setattr(selection, "extract", lambda files, *more: seen.append(files) or extract(files, *more))
    text = 'import os\na = os.getenv("A")\n'
    files = spark.createDataFrame(
        [("r", f"f{i}.py", text) for i in range(9)] + [("r", "f3.py", text), ("r", "f4.txt", text), (None, "f3.py", text)],
        "repo string, path string, content string",
    )
    changes = spark.createDataFrame(
        [("r", "f3.py", 2), ("r", "f3.py", 1), ("r", "f4.txt", 3), ("r", "gone.py", 4), (None, "f3.py", 5)],
        "repo string, path string, ord bigint",
    )
    found = selection.staged_refs(files, changes)
    assert sorted(found.select("path", "pos.rank").collect()) == [("f3.py", 1)] * 2 + [("f3.py", 2)] * 2
    assert [row["path"] for row in seen[0].collect()] == ["f3.py", "f3.py"]


def test_reader_keeps_references_in_code_only():
    read = stack.reader(PYTHON.grammar, PYTHON.anchor)
    tokens = ['f"', "os", "{", "os", "}", "os", '"', "#", "os", "\n", "os"]
    marked = "".join(f"{stack.BEGIN}{token}{stack.END}" for token in tokens)
    assert read(marked + " x") == f'f"os{{{stack.BEGIN}os}}os"#os\n{stack.BEGIN}os x'


def test_long_texts_are_read_whole(spark, files_of):
    from varscope.operators.extract import extract

    text = "".join(f'a = f"{{os.getenv(\'A{i}\')}} os.getenv(\'NO\')"\n' for i in range(5000))
    found = extract(files_of({"a.py": "import os\n" + text, "b.sh": "echo $B\n"}))
    assert found.groupBy("path").count().orderBy("path").collect() == [("a.py", 5000), ("b.sh", 1)]


def test_a_stream_reads_texts_by_the_stack(spark, tmp_path):
    rows = [("r", "a.py", 'x = f"{os.getenv(\'A\')} os.getenv(\'NO\')"\n'), ("r", "b.py", 'os.getenv("A")\n')]
    spark.createDataFrame(rows, "repo string, path string, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, path string, content string").option("maxFilesPerTrigger", 1)
    documented = spark.createDataFrame([], "repo string, name string")
    found = alerts.check_stream(stream.parquet(str(tmp_path / "in")), documented)
    alerts.run_once(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).collect() == [("r", "A")]
