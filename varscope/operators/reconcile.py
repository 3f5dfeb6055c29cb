"""Reconciling what code reads with what a template documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.functions.text import strip

MARKER = "# Added by varscope"
STALE_COMMENT = "# UNUSED (not found in codebase): "

def _found_names(found: DataFrame) -> DataFrame:
    return found.select("repo", F.col("name").alias("key"))


def existing(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Template entries whose key is read by code, unchanged."""
    return entries.join(_found_names(found), ["repo", "key"], "left_semi")


def stale(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Template entries no code reads; a notice goes ahead of their comments."""
    notice = F.array(F.concat(F.lit(STALE_COMMENT), F.col("key")))
    return entries.join(_found_names(found), ["repo", "key"], "left_anti").withColumn(
        "comments", F.concat(notice, F.col("comments"))
    )


def new(entries: DataFrame, found: DataFrame, marker: str = MARKER) -> DataFrame:
    """Names code reads that no template entry has, as entries to add."""
    documented = entries.select("repo", F.col("key").alias("name"))
    return found.join(documented, ["repo", "name"], "left_anti").select(
        "repo",
        F.col("name").alias("key"),
        F.coalesce("default_value", F.lit("")).alias("value"),
        F.array(F.lit(marker)).alias("comments"),
        F.lit(None).cast("string").alias("inline_comment"),
        F.lit(False).alias("blank_line_before"),
        F.lit("NEW").alias("status"),
        "first_pos",
    )


def reconcile(found: DataFrame, entries: DataFrame, marker: str = MARKER) -> DataFrame:
    """Merged entries with status EXISTING, STALE or NEW; ``pos`` orders them per repo.

    One full outer join decides all three, so the inventory is computed once. It joins on
    (repo, name), the key the inventory is already partitioned by and of which it has one
    row per value, so no repository or name is a hot join key.
    """
    both = entries.withColumnRenamed("key", "name").withColumn("_documented", F.lit(True)).join(
        found.select("repo", "name", "default_value", "first_pos"), ["repo", "name"], "full"
    )
    documented, read = F.col("_documented").isNotNull(), F.col("first_pos").isNotNull()
    notice = F.array(F.concat(F.lit(STALE_COMMENT), F.col("name")))
    return both.select(
        "repo",
        F.col("name").alias("key"),
        F.when(documented, F.col("value"))
        .otherwise(F.coalesce("default_value", F.lit("")))
        .alias("value"),
        F.when(~documented, F.array(F.lit(marker)))
        .when(read, F.col("comments"))
        .otherwise(F.concat(notice, F.col("comments")))
        .alias("comments"),
        "inline_comment",
        F.coalesce("blank_line_before", F.lit(False)).alias("blank_line_before"),
        F.when(~documented, "NEW").when(read, "EXISTING").otherwise("STALE").alias("status"),
        F.struct(
            F.when(documented, 0).otherwise(1).alias("side"),
            F.col("ord").cast("int").alias("ord"),
            F.when(~documented, F.col("first_pos")).alias("seen"),
        ).alias("pos"),
    )


def undescribed_comments(comments: Column, marker: str = MARKER) -> Column:
    """True if no comment says anything: only markers, lone hashes or blanks."""
    return F.forall(comments, lambda c: strip(c).isin(marker, "#", ""))


def undescribed(found: DataFrame, entries: DataFrame, marker: str = MARKER) -> DataFrame:
    """Inventory rows that need a description, with ``existing`` = already documented.

    New names, and names of which some template entry has no real comment.
    """
    per_key = entries.groupBy("repo", F.col("key").alias("name")).agg(
        F.bool_or(undescribed_comments(F.col("comments"), marker)).alias("_bare")
    )
    return (
        found.join(per_key, ["repo", "name"], "left")
        .filter(F.col("_bare").isNull() | F.col("_bare"))
        .withColumn("existing", F.col("_bare").isNotNull())
        .drop("_bare")
    )


def description_block(description: Column, example: Column, marker: str = MARKER) -> Column:
    """Comment lines that carry a description and, if there is one, an example."""
    head = F.array(
        F.lit(marker), F.lit("#"), F.concat(F.lit("# Description: "), description)
    )
    sample = F.when(
        example != "", F.array(F.concat(F.lit("# Example:     "), example))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(head, sample, F.array(F.lit("#")))


def apply_descriptions(
    merged: DataFrame, descriptions: DataFrame, marker: str = MARKER
) -> DataFrame:
    """Replace the comments of every entry that ``descriptions`` (repo, name, description,
    example) covers."""
    texts = descriptions.select(
        "repo", F.col("name").alias("key"), "description", "example"
    )
    block = description_block(F.col("description"), F.col("example"), marker)
    return (
        merged.join(texts, ["repo", "key"], "left")
        .withColumn(
            "comments",
            F.when(F.col("description").isNotNull(), block).otherwise(F.col("comments")),
        )
        .drop("description", "example")
    )


def diff(merged: DataFrame) -> DataFrame:
    """(repo, status, key, pos): the new, stale and existing names of each repo as rows."""
    return merged.select("repo", "status", "key", "pos")


def diff_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("repo").agg(
        F.count_if(F.col("status") == "NEW").alias("n_new"),
        F.count_if(F.col("status") == "STALE").alias("n_stale"),
        F.count_if(F.col("status") == "EXISTING").alias("n_existing"),
    )


def entry_lines(merged: DataFrame) -> DataFrame:
    """Rendered template: (repo, pos, text), one block of lines per entry.

    The blocks of a repo in ``pos`` order, one below the other, are its template file.
    """
    # Only template entries ask for a blank line, and the first of them has number 1.
    first = (F.col("pos.side") == 0) & (F.col("pos.ord") == 1)
    tail = F.when(
        F.col("inline_comment") != "", F.concat(F.lit(" "), F.col("inline_comment"))
    ).otherwise(F.lit(""))
    lines = F.concat(
        F.when(
            F.col("blank_line_before") & ~first, F.array(F.lit(""))
        ).otherwise(F.expr("cast(array() as array<string>)")),
        F.col("comments"),
        F.array(F.concat("key", F.lit("="), "value", tail)),
    )
    return merged.select("repo", "pos", F.array_join(lines, "\n").alias("text"))
