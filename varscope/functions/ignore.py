"""Ignore patterns as an index of literal rules and regular expressions for the others.

A repository's ordered rules become a list of regexes, one for each run of rules of the
same sign: a run of plain rules excludes, a run of negated ones takes back. Where a
repository has many rules without wildcards, these leave the runs: they are sorted keys,
and a path asks for its own few keys by binary search. The last rule that matches a path
decides, so both carry the number of a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.functions.paths import prefixes

# Matches nothing, written without a lookahead.
NEVER = "$.^"
# Noncharacters that stand for translated parts while the rest is being escaped.
_ANY_DIRS, _BELOW, _STARS, _ONE, _SEGMENT, _CLASS = (chr(0xFDD2 + n) for n in range(6))
# A character class; a `[` without its `]` is an ordinary character.
CLASS = r"(?<!\\)\[[!^]?\]?[^\]]*+\]"


def _class_regex(cls: Column) -> Column:
    """A class in which only ranges and the leading negation have a meaning."""
    negated = cls.rlike(r"^\[[!^]")
    inner = F.regexp_replace(cls, r"^\[[!^]?|\]$", "")
    quoted = F.regexp_replace(inner, r"[\[\]&^\\]", r"\\$0")
    return F.concat(F.when(negated, "[^").otherwise("["), quoted, F.lit("]"))


def unreadable(pattern: Column) -> Column:
    """True for a pattern with a range that runs backwards, which no reader accepts."""
    classes = F.regexp_extract_all(pattern, F.lit(CLASS), F.lit(0))

    def backwards(cls: Column) -> Column:
        inner = F.regexp_replace(cls, r"^\[[!^]?|\]$", "")
        ranges = F.regexp_extract_all(inner, F.lit(r"[\s\S]-[\s\S]"), F.lit(0))
        return F.exists(ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))

    return F.exists(classes, backwards)


def pattern_regex(pattern: Column) -> Column:
    """Anchored regex of one ignore pattern (sign and blanks already removed)."""
    # A trailing slash asks for a directory; a slash elsewhere ties it to the root.
    directory = pattern.endswith("/")
    body = F.regexp_replace(pattern, "/$", "")
    rooted = F.contains(body, F.lit("/"))
    body = F.regexp_replace(body, "^/", "")

    # Classes are set aside, so that nothing inside them is read as a wildcard.
    classes = F.regexp_extract_all(body, F.lit(CLASS), F.lit(0))
    body = F.regexp_replace(body, CLASS, _CLASS)
    body = F.regexp_replace(body, r"^(?:\*\*/)+", _ANY_DIRS)
    body = F.regexp_replace(body, r"/(?:\*\*/)+", "/" + _ANY_DIRS)
    body = F.regexp_replace(body, r"/\*\*$", _BELOW)
    body = F.regexp_replace(body, rf"(?<=^|/|{_ANY_DIRS})(?<!\\)\*+(?=/|$|{_BELOW})", _SEGMENT)
    body = F.regexp_replace(body, r"(?<!\\)\*+", _STARS)
    body = F.regexp_replace(body, r"(?<!\\)\?", _ONE)
    # Escaped letters and digits mean themselves; every other escape is kept.
    body = F.regexp_replace(body, r"\\([A-Za-z0-9])", "$1")
    body = F.regexp_replace(body, r"\\$", "")
    body = F.regexp_replace(body, r"(?<!\\)([.+^$(){}|\[\]])", r"\\$1")
    for mark, regex in (
        (_ANY_DIRS, "(?:.+/)?"), (_BELOW, "/.*"), (_STARS, "[^/]*"),
        (_ONE, "[^/]"), (_SEGMENT, "[^/]+"),
    ):
        body = F.replace(body, F.lit(mark), F.lit(regex))
    filled = F.zip_with(
        F.split(body, _CLASS, -1),
        F.transform(classes, _class_regex),
        lambda piece, cls: F.concat(piece, F.coalesce(cls, F.lit(""))),
    )
    body = F.array_join(filled, "")
    return F.concat(
        F.when(rooted, F.lit("^")).otherwise(F.lit("^(?:.+/)?")),
        body,
        F.when(directory, F.lit("/.*$")).otherwise(F.lit("(?:/.*)?$")),
    )


def literal_key(pattern: Column) -> Column:
    """What a path must hold for a pattern without wildcards; NULL for others.

    A name, or a slash and the path from the root; a slash at the end asks for a directory.
    """
    body = F.regexp_replace(pattern, "/$", "")
    key = F.when(F.contains(body, F.lit("/")), F.concat(F.lit("/"), F.regexp_replace(body, "^/", ""))).otherwise(body)
    ends = F.when(pattern.endswith("/"), "/").otherwise("")
    return F.when(~pattern.rlike(r"[*?\[\\]"), F.concat(key, ends))


def path_keys(path: Column) -> Column:
    """Keys of all literal rules that match a path: its names and its prefixes."""

    def of(v: Column) -> Column:
        segments, n = v["segments"], v["n"]

        def keys(k: Column) -> Column:
            name, prefix = segments[k - 1], F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/"))
            plain = F.array(name, prefix)
            below = k < F.size(segments)  # a slash follows
            return F.when(below, F.concat(plain, F.transform(plain, lambda x: F.concat(x, F.lit("/"))))).otherwise(plain)

        return F.flatten(F.transform(F.sequence(F.lit(1), n), keys))

    segments = F.split(path, "/", -1)
    n = F.size(segments) - F.when(path.endswith("/"), 1).otherwise(0)
    return F.transform(F.array(F.struct(segments.alias("segments"), n.alias("n"))), of)[0]


def parse_rules(rules: DataFrame) -> DataFrame:
    """(repo, kind, ord, negated, regex, literal); blank lines and comments are dropped."""
    text = F.when(
        F.col("pattern").rlike(r"\\[ ]$"), F.ltrim(F.col("pattern"))
    ).otherwise(F.trim(F.col("pattern")))
    negated = F.col("text").startswith("!")
    bare = F.when(negated, F.substring(F.col("text"), F.lit(2), F.length("text"))).otherwise(
        F.col("text")
    )
    return (
        rules.withColumn("text", text)
        .filter((F.col("text") != "") & ~F.col("text").startswith("#") & (F.col("text") != "/"))
        .withColumn("negated", negated)
        .withColumn("bare", bare)
        .filter(F.col("bare") != "")
        .select(
            "repo", "kind", "ord", "negated",
            F.when(unreadable(F.col("bare")), NEVER).otherwise(pattern_regex(F.col("bare"))).alias("regex"),
            literal_key(F.col("bare")).alias("literal"),
        )
    )


def rule_errors(rules: DataFrame) -> DataFrame:
    """(repo, kind, ord, pattern) of the rules that cannot be read; they exclude nothing."""
    text = F.trim(F.col("pattern"))
    return rules.filter(~text.startswith("#") & unreadable(text)).select("repo", "kind", "ord", "pattern")


# Literal rules that a repository must have before they are indexed: a few are as cheap in a regex.
INDEXED = 64
RUNS = "array<struct<negated: boolean, regex: string, mark: int>>"


def _runs(ordered: Column, indexed: Column) -> Column:
    """Join neighbouring rules of one sign to alternatives; indexed literal rules are left out.

    ``mark`` is twice the number of a run's last rule, and one more if it is negated. A run
    also ends where an indexed rule of the other sign stands, so that the last number of a
    run tells whether it comes after that rule.
    """
    start = F.struct(
        F.expr(f"cast(array() as {RUNS})").alias("runs"), F.lit(False).alias("plain"), F.lit(False).alias("negated")
    )

    def add(acc: Column, rule: Column) -> Column:
        runs = acc["runs"]
        last = F.get(runs, F.size(runs) - 1)
        crossed = F.when(rule["negated"], acc["plain"]).otherwise(acc["negated"])
        own = F.struct(rule["negated"].alias("negated"), rule["regex"].alias("regex"), rule["mark"].alias("mark"))
        longer = F.struct(
            rule["negated"].alias("negated"),
            F.concat(last["regex"], F.lit("|"), rule["regex"]).alias("regex"),
            rule["mark"].alias("mark"),
        )
        same = F.coalesce(last["negated"] == rule["negated"], F.lit(False)) & ~crossed
        joined = F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(own))
        )
        left_out = F.struct(
            runs.alias("runs"),
            (acc["plain"] | ~rule["negated"]).alias("plain"),
            (acc["negated"] | rule["negated"]).alias("negated"),
        )
        taken = F.struct(joined.alias("runs"), F.lit(False).alias("plain"), F.lit(False).alias("negated"))
        return F.when(indexed & rule["literal"].isNotNull(), left_out).otherwise(taken)

    return F.aggregate(ordered, start, add, lambda acc: acc["runs"])


def _compiled(rules: Column) -> Column:
    """STRUCT<keys, marks, runs, negations> of (ord, negated, regex, literal) rules in order."""

    def build(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda rule, n: F.struct(
                rule["negated"].alias("negated"), rule["regex"].alias("regex"), rule["literal"].alias("literal"),
                (2 * (n + 1) + rule["negated"].cast("int")).alias("mark"),
            ),
        )

        def split(marked: Column) -> Column:
            literal = F.filter(marked, lambda rule: rule["literal"].isNotNull())
            indexed = F.size(literal) > INDEXED
            keys = F.array_sort(F.transform(literal, lambda rule: F.struct(rule["literal"].alias("key"), rule["mark"].alias("mark"))))
            keys = F.when(indexed, keys).otherwise(F.expr("cast(array() as array<struct<key: string, mark: int>>)"))
            return F.struct(
                F.transform(keys, lambda k: k["key"]).alias("keys"),
                F.transform(keys, lambda k: k["mark"]).alias("marks"),
                _runs(marked, indexed).alias("runs"),
                F.exists(marked, lambda rule: rule["negated"]).alias("negations"),
            )

        return F.transform(F.array(marked), split)[0]

    return F.transform(F.array(rules), build)[0]


def exclusion_rules(rules: DataFrame) -> DataFrame:
    """One row per repo: the compiled rules of its ignore file and of its exclude globs.

    The two sets are separate: a negation in one never revives a path excluded by the
    other. A group holds one ignore file's lines, so collecting it is bounded.
    """
    def ordered(kind: str) -> Column:
        row = F.when(F.col("kind") == kind, F.struct("ord", "negated", "regex", "literal"))
        return _compiled(F.array_sort(F.collect_list(row)))

    return parse_rules(rules).groupBy("repo").agg(
        ordered("gitignore").alias("ignore_rules"),
        ordered("exclude").alias("exclude_rules"),
    )


def _mark_of(key: Column, rules: Column) -> Column:
    """Mark of the last indexed rule with this key, or -1, by binary search."""
    keys = rules["keys"]
    bits = F.length(F.bin(F.size(keys).cast("bigint")))  # halvings until one place is left
    start = F.struct(F.lit(0).alias("low"), F.size(keys).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = F.get(keys, middle) <= key
        return F.when(at["low"] >= at["high"], at).otherwise(
            F.struct(
                F.when(right, middle + 1).otherwise(at["low"]).alias("low"),
                F.when(right, at["high"]).otherwise(middle).alias("high"),
            )
        )

    place = F.aggregate(F.sequence(F.lit(1), bits), start, halve, lambda at: at["low"] - 1)
    return F.transform(
        F.array(place), lambda k: F.when((k >= 0) & (F.get(keys, k) == key), F.get(rules["marks"], k)).otherwise(-1)
    )[0]


def matches(path: Column, rules: Column) -> Column:
    """True if any gating prefix of ``path`` is excluded by ``rules`` (NULL: no rules).

    A rule that matches a directory also matches everything below it, so without
    negations the whole path decides alone. With them every prefix is asked, because an
    excluded directory keeps its content excluded. ``regexp_extract`` keeps the last
    compiled pattern, which ``rlike`` does not.
    """
    runs = rules["runs"]
    indexed = F.size(rules["keys"]) > 0

    def hit(p: Column, regex: Column) -> Column:
        return F.call_function("regexp_extract", p, regex, F.lit(0)) != ""

    def literal(p: Column) -> Column:
        marks = F.transform(path_keys(p), lambda key: _mark_of(key, rules))
        return F.when(indexed, F.array_max(marks)).otherwise(F.lit(-1))

    def decided(p: Column) -> Column:
        by_regex = F.aggregate(
            runs, F.lit(-1), lambda mark, run: F.when(hit(p, run["regex"]), run["mark"]).otherwise(mark)
        )
        last = F.greatest(by_regex, literal(p))
        return (last >= 0) & (F.pmod(last, F.lit(2)) == 0)

    plain = F.exists(runs, lambda run: hit(path, run["regex"])) | (literal(path) >= 0)
    return (
        F.when(F.coalesce(F.size(runs) + F.size(rules["keys"]), F.lit(0)) <= 0, F.lit(False))
        .when(~rules["negations"], plain)
        .otherwise(F.exists(prefixes(path), decided))
    )
