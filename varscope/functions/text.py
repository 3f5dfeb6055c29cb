"""Column helpers for text: trimming, line splitting, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Unicode-aware strip() removes, in code point order.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body, without and with the line feed.
WS_INLINE = r"\t\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = r"\n" + WS_INLINE

# Line boundaries of universal text splitting.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def decode(content: Column) -> Column:
    """UTF-8 text with U+FFFD for broken bytes; accepts BINARY or STRING."""
    return F.make_valid_utf8(content.cast("string"))


def unify_lines(text: Column) -> Column:
    """Rewrite every universal line boundary as a line feed."""
    return F.regexp_replace(text, LINE_BREAK, "\n")


def to_lines(text: Column, universal: bool = True) -> Column:
    """Array of lines; a text ending in a boundary has no extra empty last line."""
    pieces = F.split(unify_lines(text) if universal else text, "\n")
    if not universal:
        return pieces
    return F.when(
        F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).otherwise(pieces)


def unquote(value: Column) -> Column:
    """Trim, then remove one pair of equal quotes."""
    bare = strip(value)
    quoted = (F.length(bare) >= 2) & (
        (bare.startswith('"') & bare.endswith('"')) | (bare.startswith("'") & bare.endswith("'"))
    )
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def scrub_snippet(snippet: Column) -> Column:
    """Remove string literals passed as a last call argument, so defaults stay private."""
    return F.regexp_replace(snippet, r",[" + WS + r"]*([\"'])[^\n]*?\1(?=[" + WS + r"]*\))", "")
