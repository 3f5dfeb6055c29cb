"""Change-set check on a stream of changed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscope.operators.extract import file_names
from varscope.operators.joins import salts_for
from varscope.operators.languages import DEFAULT_LANGUAGES, Language


def documented_names(entries: DataFrame) -> DataFrame:
    """(repo, name) of the template entries. Store it: every micro-batch reads it."""
    return entries.select("repo", F.col("key").alias("name")).distinct()


def check_stream(
    files: DataFrame,
    documented: DataFrame,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
    event_time: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """First alert per (repo, name) that a changed file reads and no template documents.

    A file sends each name it reads once, however often it reads it. State is one row per
    undocumented name. With ``event_time`` (a timestamp column of the stream) state is
    dropped ``delay`` after a name was seen, for streams without end; such a name may then
    be reported again. A name that very many files read is first deduplicated in salted
    parts, so that it is not one task's.
    """
    keep = [event_time] if event_time else []
    salt = F.pmod(F.xxhash64("path"), F.lit(salts_for(files))).alias("_salt")
    alerts = file_names(files, languages, keep).select("repo", "name", salt, *keep)
    if event_time:
        alerts = alerts.withWatermark(event_time, delay)
    alerts = alerts.join(documented, ["repo", "name"], "left_anti")
    for part in (["repo", "name", "_salt"], ["repo", "name"]):
        alerts = alerts.dropDuplicatesWithinWatermark(part) if event_time else alerts.dropDuplicates(part)
    return alerts.drop("_salt")


def run_once(alerts: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything available now into a Parquet table and stop."""
    query = (
        alerts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
