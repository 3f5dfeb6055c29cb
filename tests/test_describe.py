import hashlib
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from varscope.sources.cache import CacheStore
from varscope.functions import naming
from varscope.operators import descriptions as D
from varscope.operators.inventory import inventory, with_position
from varscope.sources import tables

TYPES = [
    ("KEY", "SECRET", "SECRET"), ("NODEBUG", "BOOLEAN", "STRING"), ("PORT", "PORT", "INTEGER"),
    ("DB_PORT", "PORT", "INTEGER"), ("debug", "BOOLEAN", "BOOLEAN"), ("A_DSN", "URL", "STRING"),
    ("HOST", "STRING", "STRING"), ("X_CERT", "SECRET", "STRING"), ("URL", "URL", "URL"),
    ("X_TTL", "INTEGER", "STRING"), ("API_KEY_URL", "URL", "URL"), ("MYURL", "STRING", "STRING"),
    ("", "STRING", "STRING"),
]


def test_types(spark):
    rows = spark.createDataFrame([(t[0],) for t in TYPES], ["n"]).select(
        "n", naming.infer_type(F.col("n")), naming.infer_type_name_only(F.col("n"))
    )
    assert [tuple(r) for r in rows.collect()] == TYPES


DESCRIBED = [
    ("", "Environment variable", ""),
    ("api_key", "API authentication key", "your-api-key-here"),
    ("ENV", "Deployment environment name", "production"),
    ("STRIPE_API_KEY", "Stripe Api API key", "your-stripe-api-key-here"),
    ("URL", "Url configuration value", ""),
    ("_URL", " service URL", "https://.example.com"),
    ("S3BUCKET_V2API_TOKEN", "S3Bucket V2Api authentication token", "your-s3bucket-v2api-token-here"),
    ("log_level", "Log Level configuration value", ""),
    ("MAIL_DSN", "Data source name for Mail", "postgres://localhost/mail"),
    ("RSA_PRIVATE", "Private key for Rsa", "-----BEGIN PRIVATE KEY-----"),
]


def test_rules(spark):
    rows = spark.createDataFrame([(d[0],) for d in DESCRIBED], ["n"]).select(
        "n", naming.describe(F.col("n")).alias("d")
    ).select("n", "d.*")
    assert [tuple(r) for r in rows.collect()] == DESCRIBED
    assert len(naming.LAST_WORDS) == 35 and len(naming.KNOWN_NAMES) == 20


def ref(name, line, snippet, default=None, repo="r"):
    return (repo, "a.py", "python", name, line, 0, snippet, default, default is None)


def refs_of(spark, rows):
    return with_position(
        spark.createDataFrame(
            rows,
            "repo string, path string, language string, name string, line int, column int, "
            "snippet string, default_value string, is_required boolean",
        )
    )


@pytest.mark.parametrize("inline_bytes", [0, 50, 1 << 20])
def test_cache_keys(spark, inline_bytes):
    rows = [ref("A", i, s) for i, s in enumerate(["z", "é", "a", "a", "a"])]
    rows += [ref("B", 9, "x", ""), ref("C", 9, "x"), ref("D", 9, "x", "d"), ref("A", 1, "q", "v", "s")]
    rows += [ref("LONG", i, f"line {i % 7}") for i in range(500)]
    refs = refs_of(spark, rows)
    found = inventory(refs)
    expected = {}
    for r in found.collect():
        snippets = sorted(x[6] for x in rows if (x[0], x[3]) == (r.repo, r.name))
        default = "\x00none\x00" if r.default_value is None else r.default_value
        raw = r.name + ":" + ":".join(snippets) + ":" + default
        expected[r.repo, r.name] = hashlib.sha256(raw.encode()).hexdigest()
    got = {(r.repo, r.name): r.key for r in D.cache_keys(refs, found, inline_bytes).collect()}
    assert got == expected


def test_lines_are_hashed_without_the_package(spark, tmp_path, monkeypatch):
    refs = refs_of(spark, [ref("A", 1, "a"), ref("A", 2, "b")])
    seen = []
    whole = type(refs).mapInArrow
    monkeypatch.setattr(type(refs), "mapInArrow", lambda df, f, schema: seen.append(f) or whole(df, f, schema))
    D.cache_keys(refs, inventory(refs), 0)
    load = "import pickle, sys; pickle.load(sys.stdin.buffer)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(seen[0]), cwd=tmp_path, env=env, check=True)


def test_responses(spark):
    asked = [("r", n, f"b{b}") for b in range(7) for n in ("A", "B")]
    batched = spark.createDataFrame(asked, ["repo", "name", "batch_id"])
    texts = [
        ("b0", ' {"A": {"description": "d", "example": "e"}, "B": "no", "C": {}} '),
        ("b1", 'Here:\n```json\n{"A": {"description": "d"},\n"B": {"example": "e"}}\n```'),
        ("b2", "no json"),
        ("b3", '{"A": {"description": "d"}'),
        ("b4", '[{"A": {"description": "d"}}]'),
        ("b5", '{"A": {"description": null, "example": 5}, "A2": 1}'),
    ]
    rows = D.parse_responses(batched, spark.createDataFrame(texts, ["batch_id", "text"])).collect()
    assert sorted(map(tuple, rows)) == sorted(
        [("r", "A", "d", "e"), ("r", "A", "d", ""), ("r", "B", "", "e"), ("r", "A", "", "5")]
    )


def test_prompts(spark):
    rows = [ref(f"V{n:02}", n + 1, f'os.getenv("V{n:02}", "secret")', "secret") for n in range(45)]
    rows += [ref("V00", 100 + n, f"use {n}") for n in range(3)]
    refs = refs_of(spark, rows)
    batched = D.prompt_batches(inventory(refs), ("first_pos", "name")).cache()
    prompts = {r.batch_id: r.prompt.split("\n") for r in D.prompts(batched, refs).collect()}
    assert sorted(prompts) == ["r:0", "r:1", "r:2"]
    assert [len(p) for p in (prompts["r:0"], prompts["r:2"])] == [27, 12]
    assert prompts["r:0"][5] == '  V00 — seen in: os.getenv("V00"); use 0; use 1'
    assert prompts["r:2"][5].startswith("  V40 ") and prompts["r:2"][-2] == ""
    assert not any("secret" in line for p in prompts.values() for line in p[5:])


def test_lookup_resolve_upsert(spark):
    keyed = spark.createDataFrame([("r", "A_URL", "k1"), ("s", "A_URL", "k1"), ("r", "B_URL", "k2"), ("r", "C_URL", "k3")], ["repo", "name", "key"])
    cache = spark.createDataFrame([("k1", "c", ""), ("old", "o", "o")], ["key", "description", "example"])
    hits, misses = D.cache_lookup(keyed, cache)
    assert sorted((r.repo, r.name) for r in misses.collect()) == [("r", "B_URL"), ("r", "C_URL")]
    parsed = spark.createDataFrame([("r", "B_URL", "said", "x")], ["repo", "name", "description", "example"])
    assert sorted(map(tuple, D.resolve(keyed, hits, parsed).collect())) == [
        ("r", "A_URL", "c", "", "cache"),
        ("r", "B_URL", "said", "x", "response"),
        ("r", "C_URL", "C service URL", "https://c.example.com", "rule"),
        ("s", "A_URL", "c", "", "cache"),
    ]
    fresh = spark.createDataFrame([("k2", "said", "x"), ("old", "n", "n"), ("k2", "a", "b")], ["key", "description", "example"])
    assert sorted(map(tuple, D.upsert(cache, fresh).collect())) == [
        ("k1", "c", ""), ("k2", "said", "x"), ("old", "n", "n"),
    ]


def test_cache_store_and_config(spark):
    store = spark.createDataFrame(
        [("a", '["d", "e"]'), ("b", '["d"]'), ("c", '["d","e","f"]'), ("d", "{}"), ("e", "[bad"), ("f", '["", ""]')],
        ["key", "entry"],
    )
    assert sorted(map(tuple, tables.read_cache(store).collect())) == [("a", "d", "e"), ("f", "", "")]
    config = spark.createDataFrame(
        [
            ("both", "dedicated", True, ["x"], None), ("both", "project", True, ["y"], "out"),
            ("broken", "dedicated", False, ["x"], "o"), ("broken", "project", True, ["y"], "out"),
            ("bare", "dedicated", True, [], None), ("bare", "project", True, ["y"], "out"),
        ],
        "repo string, source string, valid boolean, exclude array<string>, output string",
    )
    repos = spark.createDataFrame([("both",), ("broken",), ("bare",), ("none",)], ["repo"])
    got = {r.repo: (list(r.exclude), r.output) for r in tables.resolve_config(repos, config).collect()}
    assert got == {
        "both": (["x"], ".env.example"), "broken": (["y"], "out"),
        "bare": ([], ".env.example"), "none": ([], ".env.example"),
    }


def test_last_of_repeated_keys_counts(spark):
    batched = spark.createDataFrame([("r", n, "b") for n in "ABC"], "repo string, name string, batch_id string")
    text = (
        'Sure: {"A": {"description": "old"}, "B": {"description": "b"}, "A": {"description": "new", "example": "e"}, '
        '"C": {"description": "c"}, "C": 3}'
    )
    responses = spark.createDataFrame([("b", text)], "batch_id string, text string")
    rows = D.parse_responses(batched, responses).select("name", "description", "example").collect()
    assert sorted(map(tuple, rows)) == [("A", "new", "e"), ("B", "b", "")]


def test_cache_store_writes_what_is_fresh(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "store"), compact=3)
    assert store.read().count() == 0
    entry = lambda keys, text: spark.createDataFrame(
        [(f"key{k:06d}", f"{text} {k}" * 5, None) for k in keys], "key string, description string, example string"
    ).coalesce(1)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet"))
    store.upsert(entry(range(20_000), "old"))
    before = size()
    store.upsert(entry(range(0, 20_000, 100), "new"))
    assert size() - before <= 0.05 * before
    want = {f"key{k:06d}": ("new" if k % 100 == 0 else "old") for k in range(20_000)}
    got = lambda: {r.key: r.description[:3] for r in store.read().collect()}
    assert got() == want and [kind for _, kind in store.parts()] == ["fresh", "fresh"]
    (tmp_path / "store" / "fresh-00000009").mkdir()  # a write that did not commit
    store.upsert(entry([7, 30_000], "end"))
    want |= {"key000007": "end", "key030000": "end"}
    assert [kind for _, kind in store.parts()] == ["base"] and got() == want
    store.upsert(entry([8], "two").unionByName(entry([8], "one")))
    assert got()["key000008"] == "two"
