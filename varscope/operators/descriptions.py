"""Descriptions of variables: cache, prompt batches, responses, rule fallback.

The model itself is outside: prompts are an output table, responses an input table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varscope.functions.naming import describe
from varscope.functions.text import scrub_snippet, strip
from varscope.operators.joins import join_heavy
from varscope.operators.ordering import with_ordinal
from varscope.session import materialize
from varscope.operators.reports import attach

# Variables per request and snippets per variable.
BATCH_SIZE = 20
SNIPPETS_PER_NAME = 3
# The frame of a prompt.
PROMPT_HEAD = (
    "You are a developer documentation assistant.",
    "For each environment variable below, provide a short description and a realistic "
    "example value.",
    "Respond ONLY with a JSON object where each key is the variable name and the value is "
    "an object with 'description' and 'example' fields.",
    "",
    "Variables:",
)
PROMPT_TAIL = ("", "Respond with JSON only, no markdown fencing.")
# Fixed value: stands for "no default" in a cache key.
NO_DEFAULT = "\x00none\x00"
# Snippet text per name up to which a key is hashed in one expression.
INLINE_KEY_BYTES = 1 << 20


def cache_key(name: Column, sorted_snippets: Column, default: Column) -> Column:
    """SHA-256 over name, sorted snippets and default; NULL and '' defaults differ."""
    text = F.concat(
        name, F.lit(":"), F.array_join(sorted_snippets, ":"), F.lit(":"),
        F.coalesce(default, F.lit(NO_DEFAULT)),
    )
    return F.sha2(text, 256)


def cache_keys(refs: DataFrame, found: DataFrame, inline_bytes: int = INLINE_KEY_BYTES) -> DataFrame:
    """(repo, name, key) for every inventory row.

    Equal snippets are counted before anything is grouped, so copies of a line cost one
    row. A name whose snippets fit ``inline_bytes`` is hashed from a bounded array. The
    hash is sequential by definition, so a larger name is fed to it line by line from
    sorted rows, in constant memory.
    """
    lines = refs.groupBy("repo", "name", "snippet").agg(F.count("*").alias("n"))
    sized = attach(lines, found, ["default_value", "snippet_bytes"])

    repeated = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("snippet", "n"))),
            lambda e: F.array_repeat(e["snippet"], e["n"].cast("int")),
        )
    )
    inline = (
        sized.filter(F.col("snippet_bytes") <= inline_bytes)
        .groupBy("repo", "name", "default_value")
        .agg(repeated.alias("snippets"))
        .select(
            "repo", "name",
            cache_key(F.col("name"), F.col("snippets"), F.col("default_value")).alias("key"),
        )
    )
    streamed = (
        sized.filter(F.col("snippet_bytes") > inline_bytes)
        .select("repo", "name", "snippet", "n", "default_value")
        .repartition("repo", "name")
        .sortWithinPartitions("repo", "name", "snippet")
        .mapInArrow(_line_hasher(NO_DEFAULT), "repo string, name string, key string")
    )
    return inline.unionByName(streamed)


def _line_hasher(no_default: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes runs of equal (repo, name) without holding their lines.

    The function holds plain values only, so that Python workers need no module of this
    package.
    """
    no_default_bytes = no_default.encode()

    def hash_sorted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[str, str] | None = None
        digest = hashlib.sha256()
        ending = b""

        def row(name_key: tuple[str, str], key: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"repo": [name_key[0]], "name": [name_key[1]], "key": [key]}
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for repo, name, snippet, n, default in zip(*columns):
                if (repo, name) != current:
                    if current is not None:
                        digest.update(ending)
                        yield row(current, digest.hexdigest())
                    current = (repo, name)
                    digest = hashlib.sha256(name.encode())
                    ending = b":" + (no_default_bytes if default is None else default.encode())
                piece = b":" + snippet.encode()
                for _ in range(n):
                    digest.update(piece)
        if current is not None:
            digest.update(ending)
            yield row(current, digest.hexdigest())

    return hash_sorted_lines


def cache_lookup(keyed: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with description and example, misses) of rows with a ``key``.

    Copies of the same code share one key, so a key may have very many rows. ``keyed``
    should be a stored table; ``cache`` has one row per key. They are joined once, and the
    result is stored.
    """
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"))
    marked = cache.withColumn("_cached", F.lit(True))
    met = materialize(join_heavy(keyed, marked, ["key"], counted, "n", "left"))
    hits = met.filter("_cached").drop("_cached")
    return hits, met.filter("_cached is null").select(*keyed.columns)


def prompt_batches(misses: DataFrame, order: tuple[str, ...], size: int = BATCH_SIZE) -> DataFrame:
    """Add ``ord`` and ``batch_id``: consecutive batches of ``size`` per repo."""
    number = F.floor((F.col("ord") - 1) / size).cast("bigint")
    return with_ordinal(misses, ["repo"], list(order)).withColumn(
        "batch_id", F.concat("repo", F.lit(":"), number.cast("string"))
    )


def first_snippets(refs: DataFrame, n: int = SNIPPETS_PER_NAME) -> DataFrame:
    """(repo, name, seen): scrubbed snippets of the first ``n`` references, joined.

    Spark limits each window group before the shuffle, so a frequent name sends at most
    ``n`` rows per task.
    """
    order = Window.partitionBy("repo", "name").orderBy("pos")
    return (
        refs.select("repo", "name", "pos", "snippet")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n)
        .groupBy("repo", "name")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "snippet"))).alias("_first"))
        .select(
            "repo", "name",
            F.array_join(
                F.transform("_first", lambda e: scrub_snippet(e["snippet"])), "; "
            ).alias("seen"),
        )
    )


def prompts(batched: DataFrame, refs: DataFrame) -> DataFrame:
    """(repo, batch_id, prompt); a batch holds at most BATCH_SIZE names."""
    line = F.concat(F.lit("  "), "name", F.lit(" — seen in: "), "seen")
    head = F.array(*[F.lit(text) for text in PROMPT_HEAD])
    tail = F.array(*[F.lit(text) for text in PROMPT_TAIL])
    return (
        batched.select("repo", "name", "ord", "batch_id")
        .join(first_snippets(refs), ["repo", "name"])
        .groupBy("repo", "batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_lines"))
        .select(
            "repo", "batch_id",
            F.array_join(
                F.concat(head, F.transform("_lines", lambda e: e["line"]), tail), "\n"
            ).alias("prompt"),
        )
    )


def parse_responses(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """(repo, name, description, example) of requested names a response describes.

    The text is JSON, or holds it between its first and last brace. Only object values
    count; a missing field is '', of a repeated key the last value counts; anything
    unusable gives no row.
    """
    as_map = "map<string,string>"
    whole, inner = strip(F.col("text")), F.regexp_extract("text", r"(\{[\s\S]*\})", 1)

    def usable(text: Column) -> Column:
        # The strict parser refuses repeated keys, of which the last one counts.
        keys = F.json_object_keys(text)
        repeated = F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
        return F.try_parse_json(text).isNotNull() | repeated

    valid = F.when(usable(whole), whole).when(usable(inner), inner)
    parsed = F.from_json(valid, as_map)
    answers = (
        responses.select("batch_id", F.posexplode(parsed).alias("_nth", "name", "_value"))
        .groupBy("batch_id", "name")
        .agg(F.max_by("_value", "_nth").alias("_value"))
        .filter(strip(F.col("_value")).startswith("{"))
    )
    fields = F.from_json("_value", "description string, example string")
    return (
        batched.select("repo", "name", "batch_id")
        .join(answers, ["batch_id", "name"])
        .withColumn("_fields", fields)
        .filter(F.col("_fields").isNotNull())
        .select(
            "repo", "name",
            F.coalesce("_fields.description", F.lit("")).alias("description"),
            F.coalesce("_fields.example", F.lit("")).alias("example"),
        )
    )


def resolve(requested: DataFrame, hits: DataFrame, parsed: DataFrame) -> DataFrame:
    """(repo, name, description, example, origin): cache, else response, else rules."""
    def texts(df: DataFrame, column: str) -> DataFrame:
        return df.select("repo", "name", F.struct("description", "example").alias(column))

    cached, answered = F.col("_cached"), F.col("_answered")
    return (
        requested.select("repo", "name")
        .join(texts(hits, "_cached"), ["repo", "name"], "left")
        .join(texts(parsed, "_answered"), ["repo", "name"], "left")
        .select(
            "repo", "name",
            F.coalesce(cached, answered, describe(F.col("name"))).alias("_text"),
            F.when(cached.isNotNull(), "cache")
            .when(answered.isNotNull(), "response")
            .otherwise("rule")
            .alias("origin"),
        )
        .select("repo", "name", "_text.description", "_text.example", "origin")
    )


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with ``fresh`` (key, description, example) written over it, one row per key."""
    columns = ["key", "description", "example"]
    newest = (
        fresh.groupBy("key")
        .agg(F.max(F.struct("description", "example")).alias("_text"))
        .select("key", "_text.description", "_text.example")
    )
    return cache.select(*columns).join(newest, "key", "left_anti").unionByName(newest)
