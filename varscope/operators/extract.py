"""Reference extraction: source text in, one row per configuration-variable reference out.

Everything is a narrow projection over one scan of the files: no shuffle, no window, and
Python only for texts that a stack has to read. The same code therefore serves batch tables and streams. Source text is dropped
as soon as references are known; only the referencing line is carried on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.functions import paths
from varscope.functions.text import decode, rstrip, strip, unify_lines, unquote
from varscope.operators.languages import (
    ASKS,
    DEFAULT_LANGUAGES,
    END,
    OPENS,
    SHELL_SPECIAL_NAMES,
    START,
    Language,
    LexedLanguage,
    LineLanguage,
)
from varscope.operators.stack import read_texts, reader

REF_COLUMNS = (
    "repo", "path", "language", "name", "line", "column", "snippet", "default_value",
    "is_required",
)


# ---------------------------------------------------------------------------- routing


def _route(path: Column, languages: Sequence[Language], answer: Callable[[Language], Column]) -> Column:
    name = paths.basename(path)
    # The text after the last dot is an extension if a dot and a stem come before it.
    tail = F.substring_index(name, ".", -1)
    suffix = F.when(
        F.length(name) > F.length(tail) + 1, F.concat(F.lit("."), F.lower(tail))
    )
    chain = F
    for language in languages:
        for prefix in getattr(language, "filename_prefixes", ()):
            chain = chain.when(name.startswith(prefix), answer(language))
    for language in languages:
        if language.extensions:
            chain = chain.when(suffix.isin(*language.extensions), answer(language))
    return chain.otherwise(F.lit(None).cast("string"))


def language_of(path: Column, languages: Sequence[Language] = DEFAULT_LANGUAGES) -> Column:
    """Language of a file or NULL: file-name prefixes first, then the lower-cased suffix."""
    return _route(path, languages, lambda spec: F.lit(spec.name))


def candidate_language(
    path: Column, content: Column, languages: Sequence[Language] = DEFAULT_LANGUAGES
) -> Column:
    """Language of a file whose text holds a guard word of that language, else NULL.

    This cheap substring test lets most files skip the lexer.
    """
    def guarded(spec: Language) -> Column:
        tests = [F.contains(content, F.lit(g)) for g in spec.guards]
        return F.when(reduce(Column.__or__, tests), F.lit(spec.name))

    return _route(path, languages, guarded)


def route_language(
    files: DataFrame, languages: Sequence[Language] = DEFAULT_LANGUAGES
) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path"), languages))


def supported(files: DataFrame) -> DataFrame:
    """Keep files some language covers."""
    return files.filter(F.col("language").isNotNull())


# ---------------------------------------------------------------------------- marking
#
# References are marked inside the text first, then read at the marks. Each step is a
# column of its own, because an expression used twice inside a lambda is computed twice.


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _tag_tokens(text: Column, spec: LexedLanguage) -> Column:
    """Put START tag END before every token; the tag is empty for what is no reference.

    One pass matches references, comments and literals from left to right, so a
    reference inside a comment or literal is swallowed by it. A text in which this does
    not tell code from text only has its possible openings marked here.
    """
    plain = F.regexp_replace(text, spec.token, START + "$1" + END + "$0")
    if spec.grammar is None:
        return plain
    marked = text
    for pattern, mark in spec.openers:
        marked = F.regexp_replace(marked, pattern, mark + "$0")
    return F.when(text.rlike(spec.trap), marked).otherwise(plain)


def _delimited(tagged: Column, spec: LexedLanguage) -> Column:
    """START and END around all delimiters of a text that a stack has to read; else NULL.

    A text without a reference among its delimiters need not be read.
    """
    def around(text: Column, delimiter: str) -> Column:
        return F.regexp_replace(text, delimiter, START + "$0" + END)

    def wanted(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(START + spec.anchor)), text)

    marked = around(tagged, spec.delimiter)
    if spec.wide_delimiter:
        wide = F.regexp_replace(tagged, spec.wide_opener, OPENS + "$0")
        marked = F.when(F.contains(tagged, F.lit(ASKS)), around(wide, spec.wide_delimiter)).otherwise(marked)
    return F.when(~F.contains(tagged, F.lit(START)), _let(marked, wanted))


def _keep_references(tagged: Column, stacked: Column, spec: LexedLanguage) -> Column:
    """Leave one START before every reference that is code and drop all other marks.

    ``stacked`` is the text as a stack read it, for those that ask for it.
    """
    plain = F.replace(tagged, F.lit(START + END), F.lit(""))
    plain = F.replace(plain, F.lit(START + spec.anchor + END), F.lit(START))
    if spec.grammar is None:
        return plain
    return F.when(F.contains(tagged, F.lit(START)), plain).otherwise(F.translate(stacked, OPENS + ASKS, ""))


# Numbers that one running sum covers, so that many of them do not cost their square.
_CHUNK = 256


def _running(sizes: Column) -> Column:
    """Sum of the numbers up to each one."""

    def run(sizes: Column, base: Column) -> Column:
        zero = F.struct(base.alias("sum"), F.expr("cast(array() as array<int>)").alias("sums"))
        return F.aggregate(
            sizes,
            zero,
            lambda acc, n: F.struct(
                (acc["sum"] + n).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + n)).alias("sums")
            ),
            lambda acc: acc["sums"],
        )

    def chunked(sizes: Column) -> Column:
        n_chunks = F.ceil(F.size(sizes) / _CHUNK).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), n_chunks - 1), lambda k: F.slice(sizes, k * _CHUNK + 1, F.lit(_CHUNK))
        )
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + n)
        return _let(
            chunks,
            lambda cs: F.flatten(
                F.zip_with(
                    cs,
                    F.concat(F.array(F.lit(0)), run(F.transform(cs, total), F.lit(0))),
                    lambda c, base: F.when(c.isNull(), F.array()).otherwise(run(c, base)),
                )
            ),
        )

    return _let(sizes, lambda s: F.when(F.size(s) <= _CHUNK, run(s, F.lit(0))).otherwise(chunked(s)))


def _marked_lines(marked: Column) -> Column:
    """ARRAY<STRUCT<line, snippet, columns>> of the lines that hold a START, in order."""

    def on_line(line: Column) -> Column:
        return _let(
            F.split(line["text"], START),
            lambda pieces: F.struct(
                line["line"].alias("line"),
                F.array_join(pieces, "").alias("snippet"),
                _running(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.octet_length)).alias("columns"),
            ),
        )

    lines = F.transform(F.split(marked, "\n"), lambda text, i: F.struct((i + 1).alias("line"), text.alias("text")))
    return F.transform(F.filter(lines, lambda line: F.contains(line["text"], F.lit(START))), on_line)


# ---------------------------------------------------------------------------- reading

# What is read at the marks of a line; ``default`` and ``other`` are raw text of the language.
# A line is held once, however many references it has.
HITS = "array<struct<key: string, column: int, default: string, other: string>>"
LINES = f"array<struct<line: int, snippet: string, hits: {HITS}>>"


def _no_lines() -> Column:
    return F.expr(f"cast(array() as {LINES})")


def _raw_hit(key: Column, column: Column, default: Column, other: Column) -> Column:
    return F.struct(key.alias("key"), column.alias("column"), default.alias("default"), other.alias("other"))


def _raw_line(line: Column, hits: Column) -> Column:
    return F.struct(line["line"].alias("line"), line["snippet"].alias("snippet"), hits.alias("hits"))


def _groups(marked: Column, pattern: str, *indexes: int) -> list[Column]:
    return [F.regexp_extract_all(marked, F.lit(pattern), F.lit(i)) for i in indexes]


def _on_lines(marked: Column, calls: Column, hit: Callable[[Column, Column], Column]) -> Column:
    """The lines with their hits: ``calls`` has what was read at each START, in order."""

    def given(v: Column) -> Column:
        counts = F.transform(v["lines"], lambda line: F.size(line["columns"]))
        return F.zip_with(
            v["lines"],
            _running(counts),
            lambda line, upto: _raw_line(
                line,
                F.zip_with(
                    line["columns"],
                    F.slice(v["calls"], upto - F.size(line["columns"]) + 1, F.size(line["columns"])),
                    lambda column, call: hit(call, column),
                ),
            ),
        )

    return _let(F.struct(_marked_lines(marked).alias("lines"), calls.alias("calls")), given)


def _lexed_lines(spec: LexedLanguage) -> Column:
    """One hit per START. The call pattern matches at each START exactly once, so the
    arrays of its groups and of the places run in step."""
    marked = F.col("_marked")
    keys, *more = _groups(marked, spec.call, *spec.key_groups)
    for other_keys in more:
        keys = F.zip_with(keys, other_keys, lambda a, b: F.when(a != "", a).otherwise(b))
    columns = [keys.alias("key")]
    for index, name in ((spec.default_group, "default"), (spec.other_argument_group, "other")):
        if index is not None:
            columns.append(_groups(marked, spec.call, index)[0].alias(name))

    def part(call: Column, index: int | None, name: str) -> Column:
        return F.lit("") if index is None else call[name]

    return _on_lines(
        marked,
        F.arrays_zip(*columns),
        lambda call, column: _raw_hit(
            call["key"], column,
            part(call, spec.default_group, "default"),
            part(call, spec.other_argument_group, "other"),
        ),
    )


def literal_text(literal: Column) -> Column:
    """Text between the quotes; of an interpolated literal, its first plain fragment.
    Text without quotes is returned as it is."""
    body = F.regexp_replace(
        literal, r"^[A-Za-z]{0,2}(\"\"\"|'''|\"|')([\s\S]*)\1$", "$2"
    )
    fragment = F.regexp_extract(body, r"^(?:\{[^{}]*+\})*+([^{]*+)", 1)
    quoted = literal.endswith('"') | literal.endswith("'")
    return (
        F.when(~quoted, literal)
        .when(
            literal.rlike(r"^[rR]?[fFtT][rR]?[\"']"),
            F.replace(fragment, F.lit(START), F.lit("")),
        )
        .otherwise(body)
    )


def is_shell_special(name: Column) -> Column:
    return name.isin(*SHELL_SPECIAL_NAMES)


def own_names(lines: Column, spec: LineLanguage) -> Column:
    """Names that the text itself assigns and does not export."""
    if spec.assigned is None:
        return F.expr("cast(array() as array<string>)")
    (assigned,) = _groups(lines, spec.assigned, 1)
    return F.array_except(assigned, _groups(lines, spec.exported, 1)[0]) if spec.exported else assigned


def _reference_lines(spec: LineLanguage) -> Column:
    """One hit per (name, line), alphabetical within a line; comments count."""

    def hits(line: Column) -> Column:
        read = F.concat(*(_groups(line, pattern, 1)[0] for pattern in spec.references))
        names = F.array_sort(F.array_except(read, F.col("_known")))
        return F.transform(names, lambda n: _raw_hit(n, F.lit(0), F.lit(""), F.lit("")))

    lines = F.transform(F.split("_marked", "\n"), lambda text, i: F.struct((i + 1).alias("line"), text.alias("snippet")))
    tests = [lambda line, g=g: F.contains(line["snippet"], F.lit(g)) for g in spec.guards]
    some = F.filter(lines, lambda line: reduce(Column.__or__, [test(line) for test in tests]))
    return F.transform(some, lambda line: _raw_line(line, hits(line["snippet"])))


def _declared_at_marks(spec: LineLanguage) -> str:
    return f"(?md){START}{spec.declaration}"


def _declaration_lines(spec: LineLanguage) -> Column:
    """First declaration of each name; ``_known`` lists the declared names."""
    marked = F.col("_marked")
    keyword, sign, after, beside = _groups(marked, _declared_at_marks(spec), 1, 3, 4, 5)
    calls = F.arrays_zip(
        F.col("_known").alias("name"), keyword.alias("keyword"), sign.alias("sign"),
        after.alias("after"), beside.alias("beside"),
    )
    lines = _on_lines(
        marked,
        calls,
        lambda call, column: _raw_hit(
            call["name"], column, F.concat(call["after"], call["beside"]),
            F.concat(call["keyword"], F.lit(START), call["sign"]),
        ),
    )
    # one declaration a line
    return F.filter(
        lines, lambda line, i: F.array_position(F.col("_known"), line["hits"][0]["key"]) == i + 1
    )


def _has_value(spec: LineLanguage) -> Column:
    """Whether a declaration gives its name a value."""
    given = {"text": strip(F.col("default")) != "", "sign": ~F.col("other").endswith(START)}
    chain = F
    for keyword, what in spec.valued_by:
        chain = chain.when(F.col("other").startswith(keyword), given[what])
    return F.lit(False) if chain is F else chain.otherwise(False)


# --------------------------------------------------------------------------- extraction


def _by_language(
    languages: Sequence[Language], build: Callable[[Language], Column | None], default: Column
) -> Column:
    chain = F
    for spec in languages:
        value = build(spec)
        if value is not None:
            chain = chain.when(F.col("language") == spec.name, value)
    return default if chain is F else chain.otherwise(default)


class _Stages(NamedTuple):
    """Column of each extraction step, over the columns of the step before."""

    language: Column
    text: Column
    tagged: Column
    delimited: Column
    stacked: Column
    marked: Column
    known: Column
    lines: Column
    name: Column
    default_value: Column
    is_required: Column
    snippet: Column


_stages_of: dict[tuple, _Stages] = {}


def _stages(spark: SparkSession, languages: tuple[Language, ...]) -> _Stages:
    """Steps for ``languages``; built once per application, as building takes longer than
    planning."""
    key = (spark.sparkContext.applicationId, languages)
    if key not in _stages_of:
        _stages_of[key] = _build_stages(languages)
    return _stages_of[key]


def _build_stages(languages: tuple[Language, ...]) -> _Stages:
    def named(kind: Callable[[Language], bool]) -> Column:
        return F.col("language").isin(*[s.name for s in languages if kind(s)])

    def declares(spec: Language) -> bool:
        return isinstance(spec, LineLanguage) and spec.declaration is not None

    declaring, lexed = named(declares), named(lambda s: isinstance(s, LexedLanguage))

    def tagged(spec: Language) -> Column:
        if isinstance(spec, LexedLanguage):
            return _tag_tokens(F.col("_text"), spec)
        lines = unify_lines(F.col("_text"))
        return F.regexp_replace(lines, f"(?md)^{spec.declaration}", START + "$0") if declares(spec) else lines

    def stacks(spec: Language) -> bool:
        return isinstance(spec, LexedLanguage) and spec.grammar is not None

    readers = {s.name: reader(s.grammar, s.anchor, s.element) for s in languages if stacks(s)}

    def marked(spec: Language) -> Column | None:
        return (
            _keep_references(F.col("_tagged"), F.col("_stacked"), spec) if isinstance(spec, LexedLanguage) else None
        )

    def known(spec: Language) -> Column | None:
        if declares(spec):
            return _groups(F.col("_marked"), _declared_at_marks(spec), 2)[0]
        if isinstance(spec, LineLanguage):
            specials = F.expr("cast(array() as array<string>)") if not spec.specials else F.array(*map(F.lit, spec.specials))
            return F.concat(own_names(F.col("_marked"), spec), specials)
        return None

    def lines(spec: Language) -> Column:
        if isinstance(spec, LexedLanguage):
            return F.when(F.contains("_marked", F.lit(START)), _lexed_lines(spec))
        return _declaration_lines(spec) if declares(spec) else _reference_lines(spec)

    valued = _by_language(languages, lambda s: _has_value(s) if declares(s) else None, F.lit(False))
    return _Stages(
        language=candidate_language(F.col("path"), F.col("content"), languages),
        text=F.translate(decode(F.col("content")), START + END + OPENS + ASKS, "\uFFFD" * 4),
        tagged=_by_language(languages, tagged, F.lit(None)),
        delimited=_by_language(
            languages, lambda s: _delimited(F.col("_tagged"), s) if stacks(s) else None, F.lit(None).cast("string")
        ),
        stacked=read_texts(readers)("language", "_delimited") if readers else F.lit(None).cast("string"),
        marked=_by_language(languages, marked, F.col("_tagged")),
        known=_by_language(languages, known, F.lit(None).cast("array<string>")),
        lines=_by_language(languages, lines, _no_lines()),
        name=F.when(lexed, literal_text(F.col("key"))).otherwise(F.col("key")),
        default_value=F.when(
            lexed, F.nullif(literal_text(F.col("default")), F.lit(""))
        ).when(declaring & valued, unquote(F.col("default"))),
        is_required=F.when(lexed, (F.col("default") == "") & (F.col("other") == ""))
        .when(declaring, ~valued)
        .otherwise(F.lit(True)),
        snippet=rstrip(F.col("snippet")),
    )


def extract(
    files: DataFrame,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """References of ``files`` (repo, path, content).

    Columns named in ``keep`` are carried along (for instance a list position or an event
    time). Files without language, without content or without any guard word end early.
    """
    carried = ["repo", "path", "language", *keep]
    stage = _stages(files.sparkSession, tuple(languages))
    return (
        _read(files, stage, carried)
        .select(*carried, F.explode(stage.lines).alias("_line"))
        # a line is copied for each reference only where the snippet is selected
        .select(*carried, "_line.line", "_line.snippet", "_line.hits")
        .select(*carried, "line", "snippet", F.explode("hits").alias("_hit"))
        .select(*carried, "line", "snippet", "_hit.*")
        .select(
            "*",
            stage.name.alias("name"),
            stage.default_value.alias("default_value"),
            stage.is_required.alias("is_required"),
        )
        .filter(F.col("name") != "")
        .withColumn("snippet", stage.snippet)
        .select(*REF_COLUMNS, *keep)
    )


def _read(files: DataFrame, stage: _Stages, carried: list[str]) -> DataFrame:
    """The files that may hold references, marked and ready to be read at the marks."""
    return (
        supported(files.withColumn("language", stage.language))
        .select(*carried, stage.text.alias("_text"))
        .select(*carried, stage.tagged.alias("_tagged"))
        .select(*carried, "_tagged", stage.delimited.alias("_delimited"))
        .select(*carried, "_tagged", stage.stacked.alias("_stacked"))
        .select(*carried, stage.marked.alias("_marked"))
        .select(*carried, "_marked", stage.known.alias("_known"))
    )


def file_names(
    files: DataFrame, languages: Sequence[Language] = DEFAULT_LANGUAGES, keep: Sequence[str] = ()
) -> DataFrame:
    """Each name a file reads, once: repo, path, language, name. Nothing else leaves the file."""
    carried = ["repo", "path", "language", *keep]
    stage = _stages(files.sparkSession, tuple(languages))
    keys = F.array_distinct(F.flatten(F.transform(stage.lines, lambda line: F.transform(line["hits"], lambda h: h["key"]))))
    return (
        _read(files, stage, carried)
        .select(*carried, F.explode(keys).alias("key"))
        .select(*carried, stage.name.alias("name"))
        .filter(F.col("name") != "")
    )


def extract_language(files: DataFrame, language: Language) -> DataFrame:
    """References of the files of one language only."""
    return extract(files, (language,))
