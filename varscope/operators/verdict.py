"""Documentation checks per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.operators import selection
from varscope.operators.inventory import inventory, scanned_files
from varscope.operators.joins import join_per_key
from varscope.operators.reconcile import diff_counts, entry_lines, new, reconcile
from varscope.operators.reports import json_string
from varscope.operators.template import parse_templates
from varscope.session import materialize
from varscope.sources import tables


def exit_code(n_new: Column, n_stale: Column, strict: bool, fail_on_stale: bool) -> Column:
    """1 for undocumented names, else 2 for stale ones if those count, else 0."""
    stale_counts = F.lit(strict or fail_on_stale)
    return F.when(n_new > 0, 1).when((n_stale > 0) & stale_counts, 2).otherwise(0)


def check(
    merged: DataFrame, stats: DataFrame, strict: bool = False, fail_on_stale: bool = False
) -> DataFrame:
    """(repo, status, exit_code, n_new, n_stale, scanned_files), one row per repo."""
    repos = stats.select("repo", "scanned_files")
    return (
        repos.join(diff_counts(merged), "repo", "full")
        .na.fill(0)
        .select(
            "repo",
            F.when(F.col("n_new") > 0, "fail").otherwise("pass").alias("status"),
            exit_code(F.col("n_new"), F.col("n_stale"), strict, fail_on_stale).alias("exit_code"),
            "n_new",
            "n_stale",
            "scanned_files",
        )
    )


def verdict_lines(merged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Machine-readable verdict as JSON text: (repo, section, pos, text).

    The rows of a repo by (section, pos), one below the other, are one JSON object with
    status, new_vars, stale_vars and scanned_files. A list is as many rows as it has
    names, so a repo with very many of them needs no large row.
    """
    listed = merged.filter(F.col("status").isin("NEW", "STALE"))
    last = listed.groupBy("repo", "status").agg(F.max("pos").alias("_last"))
    comma = F.when(F.col("pos") == F.col("_last"), "").otherwise(",")
    section = F.when(F.col("status") == "NEW", 1).otherwise(3)
    names = join_per_key(listed, last, ["repo", "status"], ["key"]).select(
        "repo", section.alias("section"), "pos", F.concat(json_string(F.col("key")), comma).alias("text")
    )
    pos_type = merged.schema["pos"].dataType
    def fixed(number: int, text: Column) -> DataFrame:
        return verdicts.select(
            "repo", F.lit(number).alias("section"), F.lit(None).cast(pos_type).alias("pos"),
            text.alias("text"),
        )

    status = F.concat(F.lit('{"status": "'), "status", F.lit('", "new_vars": ['))
    count = F.concat(
        F.lit('], "scanned_files": '), F.col("scanned_files").cast("string"), F.lit("}")
    )
    return (
        fixed(0, status)
        .unionByName(fixed(2, F.lit('], "stale_vars": [')))
        .unionByName(fixed(4, count))
        .unionByName(names)
    )


def drift_outputs(numbered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New and stale names of each repo, in order, with its scanned count and drift flag.

    ``numbered`` are the NEW and STALE entries with ``ord`` within (repo, status). One row
    per name at every size: ``list`` is ``new_vars`` or ``stale_vars``. A repo without
    either has one row whose list, ord and name are NULL.
    """
    named = numbered.select(
        "repo",
        F.when(F.col("status") == "NEW", "new_vars").otherwise("stale_vars").alias("list"),
        F.col("ord").cast("bigint").alias("ord"),
        F.col("key").alias("name"),
    )
    facts = verdicts.select("repo", "scanned_files", (F.col("n_new") > 0).alias("drift_detected"))
    without = facts.join(named.select("repo").distinct(), "repo", "left_anti").select(
        "repo",
        F.lit(None).cast("string").alias("list"),
        F.lit(None).cast("bigint").alias("ord"),
        F.lit(None).cast("string").alias("name"),
        "scanned_files",
        "drift_detected",
    )
    return join_per_key(named, facts, ["repo"], ["name"]).unionByName(without)


def _configured(files: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged entries, rules) of repositories that bring ignore file, template and configuration.

    ``files`` holds all of them as files; ``config`` has the exclude globs and the
    template's name (see ``tables.resolve_config``).
    """
    resolved = tables.resolve_config(files.select("repo").distinct(), config)
    rules = materialize(tables.rules_from_files(files).unionByName(selection.config_rules(resolved)))
    found = inventory(selection.walk_refs(files, rules))
    entries = parse_templates(tables.templates_from_files(files, resolved))
    return reconcile(found, entries), rules


def check_configured(
    files: DataFrame, config: DataFrame, strict: bool = False, fail_on_stale: bool = False
) -> DataFrame:
    """The verdict of repositories that bring their own ignore file, template and configuration."""
    merged, rules = _configured(files, config)
    return check(merged, scanned_files(selection.walked_paths(files, rules)), strict, fail_on_stale)


def generate_configured(files: DataFrame, config: DataFrame) -> DataFrame:
    """The template each such repository should have: (repo, pos, text), see ``entry_lines``."""
    return entry_lines(_configured(files, config)[0])


def check_changes(
    files: DataFrame,
    changes: DataFrame,
    entries: DataFrame,
    rules: DataFrame | None = None,
) -> DataFrame:
    """(repo, exit_code): 1 if the changed files of a repo read an undocumented name.

    A repo without a change list gets a full scan, ignore and exclude rules included.
    """
    refs = selection.changed_or_walked_refs(files, changes, rules)
    undocumented = (
        new(entries, inventory(refs)).groupBy("repo").agg(F.lit(1).alias("exit_code"))
    )
    repos = files.select("repo").distinct()
    return repos.join(undocumented, "repo", "left").na.fill(0, ["exit_code"])
