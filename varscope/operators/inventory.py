"""From references to one row per (repo, name).

The merged facts are ordered folds (first, last, any, count) and so combine map-side;
a name that holds a third of all references costs one partial row per task. Locations
are never gathered into one cell: they stay rows, or arrays per file, which one file's
text bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.functions import paths
from varscope.functions.naming import infer_type


def with_position(refs: DataFrame, rank: Column | None = None) -> DataFrame:
    """Add ``pos``; ``rank`` is the place in an explicit file list, 0 for a walk."""
    return refs.withColumn(
        "pos",
        F.struct(
            (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"),
            paths.parts(F.col("path")).alias("parts"),
            F.col("line"),
            F.col("column"),
        ),
    )


def _positioned(refs: DataFrame) -> DataFrame:
    return refs if "pos" in refs.columns else with_position(refs)


def default_fold(default: Column, pos: Column) -> Column:
    """First non-empty default; if there is none, the last reference's value."""
    entry = F.struct(pos.alias("pos"), default.alias("value"))
    return F.coalesce(
        F.min(F.when(default != "", entry))["value"],
        F.max(entry)["value"],
    )


def inventory(refs: DataFrame) -> DataFrame:
    """One row per (repo, name): types and flags merged in reading order.

    ``first_pos`` orders the findings of a repository as first seen.
    """
    folded = (
        _positioned(refs)
        .groupBy("repo", "name")
        .agg(
            F.min(F.struct("pos", "language")).alias("first"),
            F.max("pos").alias("last_pos"),
            F.bool_or("is_required").alias("is_required"),
            default_fold(F.col("default_value"), F.col("pos")).alias("default_value"),
            F.count("*").alias("n_locations"),
            F.sum(F.octet_length("snippet") + 1).alias("snippet_bytes"),
        )
    )
    return folded.select(
        "repo",
        "name",
        infer_type(F.col("name")).alias("inferred_type"),
        "is_required",
        "default_value",
        F.col("first.language").alias("language"),
        "n_locations",
        "snippet_bytes",
        F.col("first.pos").alias("first_pos"),
        "last_pos",
    )


def file_findings(refs: DataFrame) -> DataFrame:
    """One row per (repo, path, name) with its locations in source order."""
    location = F.struct("line", "column", "snippet")
    return (
        _positioned(refs)
        .groupBy("repo", "path", "language", "name")
        .agg(
            F.bool_or("is_required").alias("is_required"),
            default_fold(F.col("default_value"), F.col("pos")).alias("default_value"),
            F.array_sort(F.collect_list(location)).alias("locations"),
        )
    )


def scanned_files(files: DataFrame) -> DataFrame:
    """Files with a language per repo, whether or not they could be read."""
    return files.groupBy("repo").agg(F.count("language").alias("scanned_files"))


def scan_errors(unreadable: DataFrame) -> DataFrame:
    """One error row per file (repo, path, language) whose language is known but whose
    text could not be read."""
    return unreadable.filter(F.col("language").isNotNull()).select(
        "repo", "path", F.concat(F.lit("File not found: "), F.col("path")).alias("error")
    )


def scan_stats(visited: DataFrame, errors: DataFrame, found: DataFrame) -> DataFrame:
    """Per repo: files scanned, variables found, errors. No input holds source text."""
    names = found.groupBy("repo").agg(F.count("*").alias("found"))
    failed = errors.groupBy("repo").agg(F.count("*").alias("errors"))
    return (
        scanned_files(visited)
        .join(names, "repo", "left")
        .join(failed, "repo", "left")
        .select(
            "repo", "scanned_files",
            F.coalesce("found", F.lit(0)).alias("found"),
            F.coalesce("errors", F.lit(0)).alias("errors"),
        )
    )
