"""Sinks. Every write is one Spark job, so its commit makes it all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.operators.ordering import with_ordinal


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, rows clustered by repo. A large repo spans as many files as it needs."""
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_documents(lines: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Text files under ``path/repo=<repo>/``: blocks of lines in ``order``.

    Range partitioning keeps a repo's blocks in order across part files and lets a large
    repo use many of them. Reading a repo's part files by name gives its document.
    """
    (
        lines.repartitionByRange("repo", *order)
        .sortWithinPartitions("repo", *order)
        .select("repo", "text")
        .write.mode("overwrite")
        .partitionBy("repo")
        .text(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(repo, ord, text): the blocks of each repo's document, numbered as they were written.

    A file's place among the files, a split's place in the file and a line's place in the
    split give the order, whatever the number of files and splits.
    """
    lines = spark.read.schema("text string, repo string").text(path).select(
        "repo",
        F.col("text"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return with_ordinal(lines, ["repo"], ["_file", "_split", "_at"]).select("repo", "ord", "text")
