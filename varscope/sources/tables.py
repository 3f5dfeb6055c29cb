"""Input tables: source files, templates, configuration, description cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.functions import paths, text
from varscope.session import fits_broadcast

DEFAULT_OUTPUT = ".env.example"
IGNORE_FILE = ".gitignore"


def source_files(spark: SparkSession, table: str) -> DataFrame:
    """A Parquet table (repo, path, content). Directory listing is no substitute: Spark's
    file sources skip names that begin with a dot or an underscore."""
    return spark.read.parquet(table).select("repo", "path", "content")


def walk_order(files: DataFrame) -> DataFrame:
    """Add ``parts``, whose comparison gives the order a sorted walk visits files in."""
    return files.withColumn("parts", paths.parts(F.col("path")))


def env_templates(spark: SparkSession, table: str) -> DataFrame:
    """A Parquet table (repo, content); a repo without a row has an empty template."""
    return spark.read.parquet(table).select("repo", "content")


def resolve_config(repos: DataFrame, config: DataFrame) -> DataFrame:
    """One configuration per repo: the dedicated file if valid, else the project file if
    valid, else defaults. A valid but empty dedicated file still wins."""
    priority = F.when(F.col("source") == "dedicated", 0).otherwise(1)
    chosen = (
        config.filter("valid")
        .groupBy("repo")
        .agg(F.min_by(F.struct("exclude", "output"), priority).alias("c"))
    )
    return repos.select("repo").join(chosen, "repo", "left").select(
        "repo",
        F.coalesce(F.col("c.exclude"), F.expr("cast(array() as array<string>)")).alias("exclude"),
        F.coalesce(F.col("c.output"), F.lit(DEFAULT_OUTPUT)).alias("output"),
    )


def rules_from_files(files: DataFrame) -> DataFrame:
    """(repo, kind, ord, pattern): lines of the ignore file at the root of each repo."""
    lines = text.to_lines(text.decode(F.col("content")))
    root = files.filter((F.col("path") == IGNORE_FILE) & F.col("content").isNotNull())
    return root.select("repo", F.lit("gitignore").alias("kind"), F.posexplode(lines).alias("ord", "pattern"))


def templates_from_files(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo, content): the file each repo's configuration names as its template.

    ``resolved`` has one row per repo (see ``resolve_config``). Only file names decide, so
    texts of other files are dropped inside the scan when the names are counted to be few.
    """
    named = resolved.select("repo", F.col("output").alias("path"))
    if fits_broadcast(named):
        named = F.broadcast(named)
    found = files.join(named, ["repo", "path"]).filter(F.col("content").isNotNull())
    return found.select("repo", text.decode(F.col("content")).alias("content"))


def read_cache(store: DataFrame) -> DataFrame:
    """description_cache rows from stored (key, entry) with entry = JSON text.

    Entries that are not a list of exactly two are ignored.
    """
    pair = F.from_json("entry", "array<string>")
    return (
        store.select("key", pair.alias("pair"))
        .filter(F.size("pair") == 2)
        .select(
            "key",
            F.col("pair")[0].alias("description"),
            F.col("pair")[1].alias("example"),
        )
    )
