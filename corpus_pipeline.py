"""A training corpus in five stages: quality, lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as
Parquet and reads it again as the next stage's ``docs``. All stages but the last return
the columns of their input, whatever they are called; ``n_chars`` follows a changed text.
Of an empty table every stage gives an empty one; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.llm import lines, near, packing, quality, secrets
from varscope.llm.queries import table, tokenizer_path
from varscope.llm.ship import ship
from varscope.llm.tasks import carried, restored
from varscope.session import materialize

#: Posteriors and token ids are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are probably of bad quality, go.

    A null or empty text goes; repeated rows have one verdict. Texts are counted once; the
    counts are stored without them and meet the rows again by id and 128 bits of hash.
    """
    ship(spark)
    marks = {"mark1": F.xxhash64("text"), "mark2": F.xxhash64(F.lit(1), "text")}
    rows = carried(docs).withColumns(marks)
    counted = materialize(quality.with_counts(rows.select("doc_id", "text", *marks)).drop("text"))
    judged = quality.judge(counted, quality.estimate(counted)).filter(quality.PREFIX + "kept")
    kept = judged.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", *marks))).distinct()
    same = (F.col("mark1") == F.col("_mark1")) & (F.col("mark2") == F.col("_mark2"))
    return restored(rows.join(kept, same & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_semi"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go.

    A null text stays null; rows without id, and lines that only rows of one id share, stay.
    """
    ship(spark)
    found = lines.dedup_lines(carried(docs))  # its columns are doc_id, text and row, so the result is called lines
    changed = F.col("lines.n_dropped") > 0
    kept = F.when(changed, F.col("lines.kept_text")).otherwise(F.col("text"))
    return restored(found.withColumn("text", kept), docs, changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Of repeated rows one stays; documents without words have no duplicates and stay.
    """
    ship(spark)
    return near.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark. Null and empty texts stay as they are."""
    ship(spark)
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of token ids; one row per piece.

    A null or empty text is its end id alone. Of an empty table there are no sequences.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
