"""Line dedup: a line seen in an earlier document goes.

Method: levelled sorted runs. Documents come in batches of rising ``doc_id``. The index
of known lines is a list of runs: tables of line hashes and their owning document,
bucketed and sorted by hash. A batch is aggregated to one row per line hash and merged
with each run; hashes that no run knows become a run of their own. ``FANOUT`` runs of a
level are compacted into one of the next level.

Scale: text is read once for the hashes and once to write the result. A hot line is
folded map-side to one row per task before any shuffle; the runs are never shuffled, as
they are bucketed by the key the batch is aggregated by, and compacting merges their
buckets. Occurrences of a hot line meet its owner by a broadcast of the hot lines alone.
Only positions of dropped lines travel back to the documents.

Defined results. A null or empty text is one empty line. The key of a line is the line
without white space at its ends and with A-Z lowered; keys under ``min_chars`` code
points always stay. Rows that share a ``doc_id`` are one document for the comparison, so
lines they share stay in all of them; rows without ``doc_id`` keep all lines and own
none. Other columns pass through; the result's column is called ``lines``, with as many
underscores before it as it takes to differ from theirs. Lines are told apart by 128 bits
of hash.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.llm.tasks import carried
from varscope.operators.joins import join_heavy
from varscope.session import materialize, new_table_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(WHITE))
    # translate() looks up every character; lower() does the same for ASCII alone, and faster
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, UPPER.lower()))


def text_mark(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineIndex:
    """Known lines as levelled runs of (k1, k2, owner)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that lie together by key already, as those of an aggregation or a merge."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.write.option("path", new_table_path(self.spark))
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .saveAsTable(name)
        )
        return name

    def _push(self, name: str, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(self._write(self._merged(runs)), level + 1)
            self._forget(runs)

    def _merged(self, runs: list[str]) -> DataFrame:
        """No key is in two runs, so a full join on the key is their merge, bucket by bucket."""
        merged = self.spark.table(runs[0])
        for name in runs[1:]:
            run = self.spark.table(name).withColumnRenamed("owner", "other")
            merged = merged.join(run.hint("merge"), KEY, "full").select(*KEY, F.coalesce("owner", "other").alias("owner"))
        return merged

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (``k1, k2, doc_id``) of documents later than all before.

        Returns ``k1, k2, owner, n`` for the lines that must go in every other document;
        ``n`` is how often the batch has them.
        """
        known = lines.groupBy(*KEY).agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
        )
        owner = F.lit(None).cast("bigint")
        for k, name in enumerate(run for level in self.levels for run in level):
            run = self.spark.table(name).withColumnRenamed("owner", f"owner{k}")
            known = known.join(run, KEY, "left")
            owner = F.coalesce(owner, F.col(f"owner{k}"))
        decided = materialize(known.select(*KEY, "first", "last", "n", owner.alias("owner")))
        self._push(self._write(decided.filter("owner is null").select(*KEY, F.col("first").alias("owner"))))
        return decided.filter("owner is not null or last > first").select(
            *KEY, F.coalesce("owner", "first").alias("owner"), "n"
        )

    def close(self) -> None:
        self._forget([run for level in self.levels for run in level])
        self.levels = []


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``doc_id, mark, pos, k1, k2`` of the lines that can go."""
    rows = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        text_mark(F.col(text)).alias("mark"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"),
    )
    keyed = rows.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return keyed.select(
        "doc_id", "mark", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    )


# Lines that are compared with their own dropped positions only, so that a text of very many
# dropped lines does not cost their square.
CHUNK = 256


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions ``gone``."""

    def kept(v: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["lines"]) - 1) / CHUNK).cast("int")), lambda c: c * CHUNK)

        def part(start: Column) -> Column:
            own = F.filter(v["gone"], lambda p: (p >= start) & (p < start + CHUNK))
            return F.transform(
                F.array(own),
                lambda own: F.filter(
                    F.slice(v["lines"], start + 1, F.lit(CHUNK)), lambda line, k: ~F.array_contains(own, k + start)
                ),
            )[0]

        return F.array_join(F.flatten(F.transform(starts, part)), "\n")

    values = F.struct(F.split(text, "\n", -1).alias("lines"), gone.alias("gone"))
    return F.transform(F.array(values), kept)[0]


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    doc_id: str = "doc_id",
    text: str = "text",
    name: str = "lines",
) -> DataFrame:
    """The rows and, as the last column, a struct of ``kept_text, n_lines, n_dropped``."""
    spark = docs.sparkSession
    rows = carried(docs, doc_id, text)
    edges = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda n, edge: n + (F.col("doc_id") > edge).cast("int"), sorted(set(edges)), F.lit(0))
    path = new_table_path(spark)
    hashed_lines(rows, "doc_id", "text", min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, mark long, pos int, k1 long, k2 long, batch int").parquet(path)
    index = LineIndex(spark, fanout)
    try:
        owners = [
            index.add(lines.filter(F.col("batch") == k)).withColumn("batch", F.lit(k)) for k in range(len(set(edges)) + 1)
        ]
    finally:
        index.close()
    owner = reduce(DataFrame.unionByName, owners)
    counted = owner.select("batch", *KEY, "n")
    gone = join_heavy(lines, owner.drop("n"), ["batch", *KEY], counted, "n").filter("doc_id > owner")
    positions = gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))
    marked = rows.withColumn("mark", text_mark(F.col("text")))
    found = marked.join(positions, ["doc_id", "mark"], "left")
    whole = F.coalesce("text", F.lit(""))
    result = F.struct(
        F.when(F.col("gone").isNull(), whole).otherwise(without(whole, F.col("gone"))).alias("kept_text"),
        (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    own = [
        (F.col("text").cast(docs.schema[c].dataType) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns
    ]
    return found.select(*own, result.alias(free_name(docs, name)))
