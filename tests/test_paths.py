import random
import time

import pytest
from pyspark.sql import functions as F

from varscope.functions import ignore, paths, text
from varscope.operators import selection
from varscope.operators.extract import language_of
from varscope.operators.ordering import with_ordinal


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column).first()[0]


def each(spark, column, cases):
    """Cases (inputs..., expected) for which ``column`` over i0, i1, ... differs."""
    rows = [(n, *case[:-1]) for n, case in enumerate(cases)]
    names = ["n"] + [f"i{i}" for i in range(len(rows[0]) - 1)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, names).select("n", column).collect()}
    return [(case, got[n]) for n, case in enumerate(cases) if got[n] != case[-1]]


def test_suffix(spark):
    cases = [(".bashrc", ""), ("x.tar.SH", ".SH"), ("foo.", ""), ("d.d/f", ""), ("a.py", ".py"), ("a/.x.sh", ".sh")]
    assert each(spark, paths.suffix(F.col("i0")), cases) == []


def test_language(spark):
    cases = [
        ("Dockerfile", "docker"), ("a/dockerfile_notes.md", "docker"), ("Dockerfile.py", "docker"),
        ("a.PY", "python"), ("a.pyw", "python"), ("a.Tsx", "javascript"), ("a.cjs", "javascript"),
        ("a.go", "go"), ("a.fish", "shell"), (".bashrc", None), (".sh", None), ("sh", None),
        ("a.txt", None), ("MyDockerfile", None), ("x.d/py", None),
    ]
    assert each(spark, language_of(F.col("i0")), cases) == []


def test_default_directories(spark):
    cases = [
        ("build", True), ("build/a.py", False), ("x/node_modules/y/a.js", False),
        ("foo.egg-info/x.py", True), ("*.egg-info/x.py", False), ("mybuild/a.py", True),
    ]
    assert each(spark, paths.outside_default_dirs(F.col("i0")), cases) == []


def test_relative(spark):
    cases = [("/w/a/b.py", "/w", "a/b.py"), ("/w", "/w", "."), ("/wx/b.py", "/w", "b.py"), ("/w/a", "/w/", "a")]
    assert each(spark, paths.relative_to(F.col("i0"), F.col("i1")), cases) == []


def test_line_boundaries(spark):
    value = "a\r\nb\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l\n"
    assert one(spark, text.to_lines(F.col("t")), t=value) == value.splitlines()
    assert one(spark, text.to_lines(F.col("t")), t="") == []
    assert one(spark, text.to_lines(F.col("t"), universal=False), t="a\rb\n") == ["a\rb", ""]


def test_unquote(spark):
    cases = [(' "a" ', "a"), ("'a\"", "'a\""), ('"', '"'), ('""', ""), ("a\"", 'a"'), ("'a'b'", "a'b")]
    assert each(spark, text.unquote(F.col("i0")), cases) == []


def test_scrub(spark):
    cases = [
        ('os.environ.get("KEY", "value")', 'os.environ.get("KEY")'),
        ("os.getenv(\"KEY\", 'value' )", 'os.getenv("KEY" )'),
        ('ENV.fetch("KEY","a") + ENV.fetch("K2", "b")', 'ENV.fetch("KEY") + ENV.fetch("K2")'),
        ('os.environ.get("KEY", DEFAULT)', 'os.environ.get("KEY", DEFAULT)'),
        ('os.environ.get("KEY", f"x{y}")', 'os.environ.get("KEY", f"x{y}")'),
        ("os.environ.get(", "os.environ.get("),
    ]
    assert each(spark, text.scrub_snippet(F.col("i0")), cases) == []


# (rules, path, excluded)
IGNORE_CASES = [
    (["*.log"], "app.log", True),
    (["*.log"], "a/b/app.log", True),
    (["*.log"], "app.py", False),
    (["secrets/"], "secrets/k.py", True),
    (["secrets/"], "x/secrets/k.py", True),
    (["secrets/"], "secrets", False),
    (["/build"], "build/a.py", True),
    (["/build"], "x/build/a.py", False),
    (["doc/*.txt"], "doc/a.txt", True),
    (["doc/*.txt"], "doc/x/a.txt", False),
    (["doc/*.txt"], "x/doc/a.txt", False),
    (["**/foo/bar"], "a/b/foo/bar/x.py", True),
    (["abc/**"], "abc/x/y.py", True),
    (["abc/**"], "abc", False),
    (["a/**/b"], "a/b", True),
    (["a/**/b"], "a/x/y/b", True),
    (["a/**/b"], "ab", False),
    (["*.py", "!keep.py"], "keep.py", False),
    (["*.py", "!keep.py"], "x/keep.py", False),
    (["!keep.py", "*.py"], "keep.py", True),
    (["dir/", "!dir/keep.py"], "dir/keep.py", True),
    (["dir/*", "!dir/keep.py"], "dir/keep.py", False),
    (["# *.py", "", "   "], "a.py", False),
    (["\\#x.py"], "#x.py", True),
    (["\\!x.py"], "!x.py", True),
    (["a?c.py"], "abc.py", True),
    (["a?c.py"], "a/c.py", False),
    (["[ab].py"], "b.py", True),
    (["[!ab].py"], "b.py", False),
    (["[!ab].py"], "c.py", True),
    (["[0-9]x"], "5x/a.py", True),
    (["[z-a].py"], "b.py", False),
    (["a[b.py"], "a[b.py", True),
    (["a.b+c(1).py"], "a.b+c(1).py", True),
    (["a.b"], "axb", False),
    (["tests", "!tests"], "tests/a.py", False),
    (["x/*/z"], "x/y/z", True),
    (["x/*/z"], "x/y/y/z", False),
    (["*"], "a/b.py", True),
    (["/"], "a.py", False),
    (["foo  "], "foo", True),
    (["foo\\ "], "foo ", True),
    (["[[]x"], "[x", True),
    (["[[]x"], "ax", False),
    (["a[&&]b"], "a&b", True),
    (["[a&&b].txt"], "a.txt", True),
    (["[a&&b].txt"], "&.txt", True),
    (["[*]x"], "ax", False),
    (["[*]x"], "*x", True),
    (["[?]x"], "ax", False),
    (["[?]x"], "?x", True),
    (["[]a]x"], "]x", True),
    (["[^a]x"], "^x", True),
    (["[a^]x"], "^x", True),
    (["[a-\\]"], "a", False),
    (["[+-\\]]"], "-]", True),
    (["x[0-9][!a-c].py"], "x1d.py", True),
    (["x[0-9][!a-c].py"], "x1b.py", False),
]


@pytest.mark.parametrize("small", [True, False])
def test_ignore_rules(spark, small):
    rules, files = [], []
    for n, (patterns, path, _) in enumerate(IGNORE_CASES):
        rules += [(f"r{n}", "gitignore", i, p) for i, p in enumerate(patterns)]
        files.append((f"r{n}", path))
    rules_df = spark.createDataFrame(rules, "repo string, kind string, ord int, pattern string")
    files_df = spark.createDataFrame(files, "repo string, path string")
    kept = {r.repo for r in selection.apply_rules(files_df, rules_df, small=small).collect()}
    wrong = [
        case for n, case in enumerate(IGNORE_CASES) if (f"r{n}" not in kept) != case[2]
    ]
    assert wrong == []


def test_rule_sets_do_not_mix(spark):
    rules = spark.createDataFrame(
        [("r", "gitignore", 1, "*.py"), ("r", "exclude", 1, "!a.py"), ("r", "exclude", 2, "b")],
        "repo string, kind string, ord int, pattern string",
    )
    files = spark.createDataFrame([("r", "a.py"), ("r", "b/c.go"), ("r", "c.go"), ("s", "a.py")], ["repo", "path"])
    assert sorted(map(tuple, selection.apply_rules(files, rules).collect())) == [("r", "c.go"), ("s", "a.py")]


def test_runs_of_rules_are_compact(spark):
    rules = spark.createDataFrame(
        [("r", "gitignore", n, p) for n, p in enumerate(["a", "b", "!b", "!c", "d", "[z-a]"])],
        "repo string, kind string, ord int, pattern string",
    )
    row = ignore.exclusion_rules(rules).first()
    assert list(row.exclude_rules.runs) == []
    assert [(r.negated, r.mark) for r in row.ignore_rules.runs] == [(False, 4), (True, 9), (False, 12)]
    assert row.ignore_rules.negations and row.ignore_rules.keys == []
    assert [tuple(r) for r in ignore.rule_errors(rules).collect()] == [("r", "gitignore", 5, "[z-a]")]


@pytest.mark.parametrize("indexed", [0, 2])
def test_index_gives_the_rows_of_the_regexes(spark, monkeypatch, indexed):
    rng = random.Random(indexed)
    names = ["a", "b", "c.py", "d"]
    pattern = lambda: rng.choice(["", "", "/"]) + "/".join(rng.choices(names, k=rng.choice([1, 1, 2]))) + rng.choice(["", "", "/"])
    wild = ["*.py", "b/*", "**/d", "a/**"]
    rules, files = [], []
    for n in range(60):
        for k in range(rng.randrange(1, 12)):
            rules.append((f"r{n}", "gitignore", k, rng.choice(["", "", "!"]) + (rng.choice(wild) if rng.random() < 0.3 else pattern())))
        files += [(f"r{n}", "/".join(rng.choices(names, k=rng.randrange(1, 5)))) for _ in range(12)]
    rules_df = spark.createDataFrame(rules, "repo string, kind string, ord int, pattern string")
    files_df = spark.createDataFrame(files, "repo string, path string")
    by_regex = sorted(map(tuple, selection.apply_rules(files_df, rules_df).collect()))
    monkeypatch.setattr(ignore, "INDEXED", indexed)
    assert sorted(map(tuple, selection.apply_rules(files_df, rules_df).collect())) == by_regex
    assert 100 < len(by_regex) < len(files) - 100


def test_many_literal_rules_cost_little(spark):
    files = spark.range(20_000).selectExpr("'r' as repo", "'src/f' || id % 5000 || '/x' || id || '.py' as path").cache()
    files.count()
    seconds = {}
    for n in (100, 100, 10_000):
        rules = spark.range(n).selectExpr("'r' as repo", "'gitignore' as kind", "cast(id as int) as ord", "'src/f' || id || '/' as pattern")
        start = time.perf_counter()
        kept = selection.apply_rules(files, rules).count()
        seconds[n] = time.perf_counter() - start
        assert kept == 20_000 - 4 * min(n, 5000)
    assert seconds[10_000] < 3 * seconds[100] + 3


def test_ten_thousand_rules(spark):
    signs = ["*.py"] + [f"{'!' if n % 2 else ''}f{n}.py" for n in range(10_000)]
    rules = spark.createDataFrame(
        [("r", "gitignore", n, p) for n, p in enumerate(signs)], "repo string, kind string, ord int, pattern string"
    )
    files = spark.createDataFrame([("r", f"f{n}.py") for n in (0, 1, 9_998, 9_999)] + [("r", "x.py"), ("r", "x.go")], ["repo", "path"])
    kept = {r.path for r in selection.apply_rules(files, rules).collect()}
    assert kept == {"f1.py", "f9999.py", "x.go"}


def test_ordinals_are_dense_over_many_slices(spark):
    rows = spark.range(5000).selectExpr(
        "if(id % 3 = 0, 'hot', 'g' || id % 50) as g", "pmod(hash(id), 100000) * 10000 + id as v"
    )
    got = with_ordinal(rows.repartition(16), ["g"], ["v"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r.g, []).append((r.ord, r.v))
    for pairs in by_group.values():
        pairs.sort()
        assert [o for o, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [v for _, v in pairs] == sorted(v for _, v in pairs)
