"""Reports as ordered text rows.

A report of a repository can be as long as the repository is large, so it is never put
into one cell: its rows sort by (repo, section, finding, part, pos), every row is bounded
by one finding's facts or one file's references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.operators.joins import join_heavy, join_per_key

ORDER = ("section", "finding", "part", "pos")
MARKDOWN_HEAD = "| Name | Type | Required | Default | Locations |\n| --- | --- | --- | --- | --- |\n"


def attach(rows: DataFrame, found: DataFrame, facts: list[str]) -> DataFrame:
    """Join rows of references with ``facts`` of their inventory row, whose own counts
    tell which names have very many of them."""
    keys = ["repo", "name"]
    return join_heavy(rows, found.select(*keys, *facts), keys, found, "n_locations")


def json_string(text: Column) -> Column:
    """``text`` as a JSON literal, NULL as null."""
    quoted = F.to_json(F.struct(text.alias("v")))
    inner = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    return F.when(text.isNull(), "null").otherwise(inner)


def _rows(df: DataFrame, section: int, finding: Column, part: int, pos: Column, text: Column):
    return df.select(
        "repo",
        F.lit(section).alias("section"),
        finding.alias("finding"),
        F.lit(part).alias("part"),
        pos.alias("pos"),
        text.alias("text"),
    )


def report_json(refs: DataFrame, found: DataFrame, stats: DataFrame, errors: DataFrame) -> DataFrame:
    """JSON report with two-space indent as blocks of whole lines.

    All inputs should be stored tables, as each is read more than once.
    """
    pos_type = refs.schema["pos"].dataType
    no_pos = F.lit(None).cast(pos_type)
    last_finding = found.groupBy("repo").agg(F.max(F.struct("first_pos", "name")).alias("_last"))
    has_findings = F.col("_last").isNotNull()
    comma = lambda done: F.when(done, "").otherwise(",")

    stats = stats.join(last_finding, "repo", "left")
    finding = F.struct(F.col("first_pos"), F.col("name"))
    no_finding = F.lit(None).cast(last_finding.schema["_last"].dataType)
    opening = _rows(
        stats, 0, no_finding, 0, no_pos,
        F.when(has_findings, '{\n  "findings": [').otherwise('{\n  "findings": [],'),
    )
    flag = F.when(F.col("is_required"), "true").otherwise("false")
    head = _rows(
        found, 1, finding, 0, no_pos,
        F.concat(
            F.lit('    {\n      "name": '), json_string(F.col("name")),
            F.lit(',\n      "inferred_type": '), json_string(F.col("inferred_type")),
            F.lit(',\n      "is_required": '), flag,
            F.lit(',\n      "default_value": '), json_string(F.col("default_value")),
            F.lit(',\n      "language": '), json_string(F.col("language")),
            F.lit(',\n      "locations": ['),
        ),
    )
    located = attach(refs, found, ["first_pos", "last_pos"])
    body = _rows(
        located, 1, finding, 1, F.col("pos"),
        F.concat(
            F.lit('        {\n          "file": '), json_string(F.col("path")),
            F.lit(',\n          "line": '), F.col("line").cast("string"),
            F.lit(',\n          "column": '), F.col("column").cast("string"),
            F.lit(',\n          "snippet": '), json_string(F.col("snippet")),
            F.lit("\n        }"), comma(F.col("pos") == F.col("last_pos")),
        ),
    )
    foot = _rows(
        join_per_key(found, last_finding, ["repo"], ["name"]), 1, finding, 2, no_pos,
        F.concat(F.lit("      ]\n    }"), comma(finding == F.col("_last"))),
    )
    tally = F.concat(
        F.when(has_findings, "  ],\n").otherwise(""),
        F.lit('  "scanned_files": '), F.col("scanned_files").cast("string"),
        F.lit(',\n  "errors": ['),
        F.when(F.col("errors") == 0, "]\n}").otherwise(""),
    )
    counts = _rows(stats, 2, no_finding, 0, no_pos, tally)
    error_pos = F.struct(
        F.lit(0).cast("bigint"), F.split("path", "/"), F.lit(0), F.lit(0)
    ).cast(pos_type)
    last_error = errors.groupBy("repo").agg(F.max(F.split("path", "/")).alias("_last_path"))
    error_rows = _rows(
        join_per_key(errors, last_error, ["repo"], ["path"]), 3, no_finding, 0, error_pos,
        F.concat(
            F.lit("    "), json_string(F.col("error")),
            comma(F.split("path", "/") == F.col("_last_path")),
        ),
    )
    closing = _rows(
        stats.filter("errors > 0"), 4, no_finding, 0, no_pos, F.lit("  ]\n}")
    )
    return (
        opening.unionByName(head).unionByName(body).unionByName(foot)
        .unionByName(counts).unionByName(error_rows).unionByName(closing)
    )


def report_markdown(refs: DataFrame, found: DataFrame, repos: DataFrame) -> DataFrame:
    """Markdown table as text pieces: put together in order, without separator, they are
    the report. The locations of one name in one file are one piece."""
    pos_type = refs.schema["pos"].dataType
    no_pos = F.lit(None).cast(pos_type)
    finding = F.struct(F.col("first_pos"), F.col("name"))
    finding_type = found.select(finding.alias("f")).schema["f"].dataType
    opening = _rows(repos, 0, F.lit(None).cast(finding_type), 0, no_pos, F.lit(MARKDOWN_HEAD))
    head = _rows(
        found, 1, finding, 0, no_pos,
        F.concat(
            F.lit("| "), "name", F.lit(" | "), "inferred_type", F.lit(" | "),
            F.when(F.col("is_required"), "yes").otherwise("no"), F.lit(" | "),
            F.coalesce("default_value", F.lit("")), F.lit(" | "),
        ),
    )
    # One row per file first: a frequent name then joins file rows, not references.
    per_file = (
        refs.groupBy("repo", "name", "path", F.col("pos.rank").alias("_rank"))
        .agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list("line")).alias("_lines"))
    )
    located = attach(per_file, found, ["first_pos"])
    places = F.array_join(
        F.transform("_lines", lambda n: F.concat(F.col("path"), F.lit(":"), n.cast("string"))),
        "<br>",
    )
    body = _rows(
        located, 1, finding, 1, F.col("pos"),
        F.concat(F.when(F.col("pos") == F.col("first_pos"), "").otherwise("<br>"), places),
    )
    foot = _rows(found, 1, finding, 2, no_pos, F.lit(" |\n"))
    return opening.unionByName(head).unionByName(body).unionByName(foot)


def whole_lines(pieces: DataFrame) -> DataFrame:
    """(repo, section, finding, text): the pieces of ``report_markdown`` as lines for a sink.

    A line of the table holds all locations of one finding, as the format demands.
    """
    piece = F.struct("part", "pos", "text")
    joined = pieces.groupBy("repo", "section", "finding").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    text = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    return joined.select("repo", "section", "finding", F.regexp_replace(text, r"\n$", "").alias("text"))
