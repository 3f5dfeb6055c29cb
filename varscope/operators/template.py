"""Parsing documented-variable templates (`KEY=value` files with comments).

A template is one cell, so it is parsed inside its row: the text is cut after every key
line, and each cut holds the comments and blanks that belong to the key at its end. No
shuffle and no window; rows appear only when entries do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.functions.text import (
    WS,
    WS_INLINE,
    decode,
    lstrip,
    rstrip,
    strip,
    to_lines,
    unify_lines,
)
from varscope.operators.languages import START

_KEY_LINE = (
    rf"(?md)^[{WS_INLINE}]*+(?:export[{WS_INLINE}]++)?([A-Za-z_][A-Za-z0-9_]*+)=([^\n]*+)$"
)


def line_kind(line: Column) -> Column:
    """blank, comment, key or other."""
    return (
        F.when(strip(line) == "", "blank")
        .when(lstrip(line).startswith("#"), "comment")
        .when(line.rlike(_KEY_LINE), "key")
        .otherwise("other")
    )


def template_lines(templates: DataFrame) -> DataFrame:
    """(repo, line, text, kind), lines numbered from 1."""
    return (
        templates.select("repo", F.posexplode(to_lines(decode(F.col("content")))))
        .select("repo", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))
        .withColumn("kind", line_kind(F.col("text")))
    )


def split_value(raw: Column) -> Column:
    """STRUCT<value, inline_comment> of the text after `=`."""
    bare = strip(raw)
    cut = F.regexp_instr(bare, F.lit(rf"[{WS}]++#"))
    value = F.when(cut > 0, strip(F.substring(bare, F.lit(1), cut - 1))).otherwise(bare)
    inline = F.when(cut > 0, strip(F.substring(bare, cut, F.length(bare))))

    def between(quote: str) -> Column:
        closed = bare.rlike(rf"(?s)^{quote}.*{quote}")
        inner = F.regexp_extract(bare, rf"(?s)^{quote}(.*){quote}", 1)
        return F.when(closed, inner).otherwise(F.substring(bare, F.lit(2), F.length(bare)))

    return F.struct(
        F.when(bare.startswith('"'), between('"'))
        .when(bare.startswith("'"), between("'"))
        .otherwise(value)
        .alias("value"),
        F.when(~(bare.startswith('"') | bare.startswith("'")), inline).alias("inline_comment"),
    )


def _place(lines: Column, kind: str, pick) -> Column:
    """Greatest or smallest index of a line of ``kind``, NULL if there is none."""
    return pick(F.transform(lines, lambda l, i: F.when(line_kind(l) == kind, i)))


def parse_templates(templates: DataFrame) -> DataFrame:
    """template_entries: one row per key line, numbered from 1, duplicates kept.

    A comment belongs to the next key unless a blank line comes between. The blank flag
    tells whether a blank line came since the previous key; ahead of the first key a
    blank counts only below a comment.
    """
    text = F.replace(unify_lines(decode(F.col("content"))), F.lit(START), F.lit(" "))
    cuts = F.split(F.regexp_replace(text, _KEY_LINE, "$0" + START), START)
    body = F.col("_body")
    last_blank = F.col("_last_blank")
    return (
        templates.select("repo", F.posexplode(cuts).alias("_cut", "_text"))
        # The line feed that ended the previous key line opens the next cut.
        .withColumn(
            "_lines",
            F.split(
                F.when(F.col("_cut") > 0, F.regexp_replace("_text", "^\n", "")).otherwise(
                    F.col("_text")
                ),
                "\n",
            ),
        )
        .withColumn("_key_line", F.element_at("_lines", -1))
        .filter(F.col("_key_line").rlike(_KEY_LINE) & F.col("_text").endswith(F.col("_key_line")))
        .withColumn("_body", F.slice("_lines", F.lit(1), F.size("_lines") - 1))
        .withColumn("_last_blank", F.coalesce(_place(body, "blank", F.array_max), F.lit(-1)))
        .withColumn("_first_comment", _place(body, "comment", F.array_min))
        .withColumn("_split", split_value(F.regexp_extract("_key_line", _KEY_LINE, 2)))
        .select(
            "repo",
            (F.col("_cut") + 1).alias("ord"),
            F.regexp_extract("_key_line", _KEY_LINE, 1).alias("key"),
            F.col("_split.value").alias("value"),
            F.transform(
                F.filter(
                    body, lambda l, i: (line_kind(l) == "comment") & (i > last_blank)
                ),
                rstrip,
            ).alias("comments"),
            F.col("_split.inline_comment").alias("inline_comment"),
            F.when(F.col("_cut") > 0, last_blank >= 0)
            .otherwise(F.coalesce(F.col("_first_comment") < last_blank, F.lit(False)))
            .alias("blank_line_before"),
        )
    )
