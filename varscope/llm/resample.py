"""Importance resampling of documents towards a target distribution.

Method: words and runs of words are hashed into buckets. Per bucket, the log ratio of its
share in the target and in the corpus is a whole number, its gain; the gains are one
array, and a document's weight is the mean of the entries its features point at. A fixed
pseudo-random Gumbel term per ``doc_id`` turns the largest scores into a weighted draw
without replacement. The cutoff of the draw is found by numeric bisection: exact count
jobs over the stored scores narrow an interval of whole numbers until one score is left,
then the same over the ids tied at it. Only drawn rows are range partitioned and ranked.

Scale: the text is read once; its bucket numbers are stored, some two bytes a word. Counts
are combined map-side, and at most ``buckets`` rows reach the driver, whatever the number
of documents. A count job reads stored numbers only and settles ``SECTIONS`` thresholds.
Nothing is joined and no row of a document is shuffled but the drawn ones.

Defined results. A null or empty text has no features and weight 0. A row without
``doc_id`` takes part with an empty id and comes last among ties. Repeated rows are rows
of their own; those that tie in all three of score, id and features are alike, and as many
as are needed are drawn. Other columns of the input are ignored. Of an empty table the
result is empty; with an empty target all weights follow from the corpus alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.llm.tasks import text_rows
from varscope.operators.ordering import with_ordinal
from varscope.session import materialize

# What a word is, after A-Z have become lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Thresholds that one count job settles: four halvings of the interval.
SECTIONS = 15
_LAST_ID = (1 << 63) - 1


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def runs(words: Column, length: int) -> Column:
    """All runs of ``length`` consecutive words, joined by one space."""
    if length == 1:
        return words
    starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda k: k + length <= F.size(words))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k + 1, F.lit(length)), " "))


def hashed(features: Column, buckets: int) -> Column:
    return F.transform(features, lambda f: F.pmod(F.crc32(f), F.lit(buckets)).cast("int"))


def features(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, buckets`` of (doc_id, text) rows: a bucket number for each feature."""
    found = docs.select("doc_id", words(F.col("text")).alias("words"))
    numbers = [hashed(runs(F.col("words"), n), buckets) for n in range(1, longest + 1)]
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.concat(*numbers) if longest > 1 else numbers[0]).alias("buckets"),
    )


def bucket_counts(hashed_docs: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket; counted over all rows, at most one row a bucket comes back."""
    counts = [0] * buckets
    for r in hashed_docs.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        counts[r["b"]] = r["count"]
    return counts


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Per bucket, a thousand times the log ratio of the smoothed shares, rounded down."""
    n, of_corpus, of_target = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(1000 * math.log(((t + 1) * (of_corpus + n)) / ((s + 1) * (of_target + n))))
        for s, t in zip(corpus, target)
    ]


def number_array(values: list[int]) -> Column:
    """A constant array, folded to one literal whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scored(hashed_docs: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``."""
    table = number_array(gain)
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(table, b))
    weight = F.when(F.size("buckets") == 0, F.lit(0)).otherwise(F.floor(total / F.size("buckets"))).cast("bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    rows = hashed_docs.select(
        "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise")
    )
    return rows.withColumn("score", F.col("weight") + F.col("noise")).drop("noise")


def cutoff(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int, int]:
    """(value, rows still needed at it, rows that have it) of the ``wanted``-th smallest key.

    ``wanted`` is at least 1 and at most the number of rows.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below, upto = 0, None  # rows under ``low``; rows up to ``high``
    while low < high:
        width = high - low
        marks = sorted({low + width * (k + 1) // (SECTIONS + 1) for k in range(SECTIONS)} - {high})
        within = rows.where((key >= low) & (key <= high))
        counts = within.agg(*(F.count_if(key <= m).alias(f"c{k}") for k, m in enumerate(marks))).first()
        start = below
        for mark, count in zip(marks, counts):
            if start + count >= wanted:
                high, upto = mark, start + count
                break
            low, below = mark + 1, start + count
    if upto is None:
        upto = below + rows.where(key == low).count()
    return low, wanted - below, upto - below


def drawn(scores: DataFrame, share: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The stored scores with ``rank`` 1, 2, 3 ... of the drawn rows; null for the others."""
    able = F.col("n_words") >= min_words
    wanted = share * scores.where(able).count() // 100
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return scores.select("*", undrawn)
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(_LAST_ID)), F.col("n_features")]
    tied, surely, needed = scores.where(able), [], wanted
    equal = able
    for key in keys:
        value, needed, there = cutoff(tied, key, needed)
        surely.append(equal & (key < value))
        equal = equal & (key == value)
        tied = tied.where(key == value)
        if needed == there:  # all rows of this key are drawn, so there is no tie to settle
            break
    better = reduce(Column.__or__, surely)
    if needed == there:
        chosen, rest = scores.where(better | equal), scores.where(~(better | equal))
    else:  # rows that are alike in every column: some of them are drawn
        alike = scores.where(equal).groupBy(*scores.columns).count()
        part = lambda n: alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*scores.columns)
        chosen = scores.where(better).unionByName(part(F.lit(needed)))
        rest = scores.where(~(better | equal)).unionByName(part(F.col("count") - needed))
    order = {"_k0": keys[0], "_k1": keys[1], "_k2": keys[2], "_k3": F.monotonically_increasing_id()}
    ranked = with_ordinal(chosen.withColumns(order), [], list(order), "rank").drop(*order)
    return ranked.withColumn("rank", F.col("rank").cast("bigint")).unionByName(rest.select("*", undrawn))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = PERCENT,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_features, weight, score, rank``.

    ``share`` percent of the documents of at least ``min_words`` words are drawn, so that
    their features come nearer to those of the ``target`` rows.
    """
    stored = materialize(features(text_rows(docs, doc_id, text), buckets, longest))
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text).cast("string").alias("text"))
    gain = gains(bucket_counts(stored, buckets), bucket_counts(features(wanted, buckets, longest), buckets))
    return drawn(materialize(scored(stored, gain, seed)), share, min_words)
