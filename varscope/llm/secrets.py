"""Secret scans with column functions only.

Base kinds are patterns. The method adds candidates by entropy: over every candidate
string a window of ``WINDOW`` characters slides; its character counts change by one in
and one out, and so does the sum of c log c from which the Shannon entropy follows. A
candidate whose best window reaches the threshold of its character class is a secret,
unless the allow-list suppresses it. Base spans are never suppressed.

A candidate ends at ``=``, but for padding. A candidate shorter than the window is its own
window. A placeholder word suppresses only the part between ``/``, ``_`` and ``-`` that it
stands in: what is left is scored by itself, and the span is the whole candidate.

Scale: one narrow pass, no shuffle. A pattern's matches and the text between them give
the positions by running sums; only texts that match pay for more than the search.

Patterns repeat no group that could give characters back, so a long text neither recurses
nor backtracks.

Defined results. Spans count code points, the end exclusive. Null and empty texts have
no spans. Rows are independent, so ties, repeated rows and missing ids need no rule;
other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.llm.tasks import carried, restored

# The patterns of the base kinds, and how long a match must be.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

KINDS = ("assign", "access", "hex", "entropy")
WINDOW, SHORTEST = 20, 16
# Maximal runs that are long enough, with their padding; a match begins where its run does.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}+" % SHORTEST
MARK = "[SECRET]"

# Entropy is compared as whole millionths of c * log2(c), so that sums are exact.
UNIT = 1_000_000
TERMS = [round(UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


@dataclass(frozen=True)
class CharacterClass:
    """Candidates that match ``pattern`` as a whole, and the bits a window of them needs."""

    pattern: str
    bits: float

    def most(self, window: int = WINDOW) -> int:
        """The largest sum of c log c at which the entropy of a window reaches the threshold."""
        return math.floor(UNIT * window * (math.log2(window) - self.bits))


# Candidates need a digit and a letter; the first class that matches counts.
CLASSES = (
    CharacterClass(r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    CharacterClass(r"^[A-Za-z0-9]+$", 3.4),
    CharacterClass(r"^[A-Za-z0-9+/_=-]+$", 3.6),
)

# Candidates that are no secrets: universal ids, paths and names of plain words and numbers.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*+[0-9]*+(?:[/_=+-]++(?:[A-Za-z]++|[0-9]++))*+[/_=+-]*+$",
)
# Parts of candidates that are no secrets.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|^your$|dummy|xxxx|0123456789|abcdefgh"

CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _fold(steps: Column, base: Column) -> Column:
    """Running spans of (gap, size) steps from ``base`` on."""
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def add(acc, step):
        start = acc["at"] + step["gap"]
        end = start + step["size"]
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"),
        )

    return F.aggregate(steps, F.struct(base.alias("at"), none.alias("out")), add, lambda acc: acc["out"])


def positions(steps: Column) -> Column:
    """Spans of all steps. In chunks, so that thousands of matches do not cost their square."""
    n_chunks = F.ceil(F.size(steps) / CHUNK).cast("int")
    chunks = F.transform(
        F.filter(F.sequence(F.lit(0), n_chunks), lambda k: k < n_chunks), lambda k: F.slice(steps, k * CHUNK + 1, CHUNK)
    )
    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda at, s: at + s["gap"] + s["size"])

    def spans(chunks):
        sizes = F.transform(chunks, lambda c: F.struct(F.lit(0).alias("gap"), total(c).alias("size")))
        return let(
            _fold(sizes, F.lit(0)),
            lambda places: F.flatten(F.zip_with(chunks, places, lambda c, place: _fold(c, place["start"]))),
        )

    return F.when(n_chunks <= 1, _fold(steps, F.lit(0))).otherwise(let(chunks, spans))


def matches(text: Column, pattern: str, group: int = 0, seek: str | None = None) -> Column:
    """``start, end, match, part`` of each match; ``part`` is the group. Null if there is none.

    ``seek`` is a cheaper pattern that every text with a wanted match contains.
    """
    found = text.rlike(seek or pattern)
    gaps = F.when(found, F.split(text, pattern, -1))
    whole = F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    parts = F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else whole

    def place(v):
        steps = F.zip_with(
            F.slice(v["gaps"], 1, F.size(v["whole"])),
            v["whole"],
            lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size")),
        )
        return F.zip_with(
            let(steps, positions),
            F.arrays_zip(v["whole"].alias("match"), v["parts"].alias("part")),
            lambda span, m: F.struct(span["start"], span["end"], m["match"], m["part"]),
        )

    values = F.struct(gaps.alias("gaps"), whole.alias("whole"), parts.alias("parts"))
    return F.when(found, let(values, place))


def least_sum(candidate: Column) -> Column:
    """Smallest sum of c log c over all windows of the candidate, by incremental counts."""
    terms = F.array(*(F.lit(t) for t in TERMS))
    chars = F.regexp_extract_all(candidate, F.lit("."), F.lit(0))

    def slide(v):
        codes, size, window = v["codes"], v["size"], v["window"]
        zero = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0))

        def step(acc, k):
            came = codes[k]
            went = F.when(k >= window, codes[k - window]).otherwise(F.lit(0))
            at = lambda code: F.get(acc["counts"], code - 1)
            same = came == went
            total = (
                acc["total"]
                + F.when(same, 0).otherwise(
                    terms[at(came) + 1]
                    - terms[at(came)]
                    + F.when(went > 0, terms[at(went) - 1] - terms[at(went)]).otherwise(0)
                )
            )
            counts = F.when(same, acc["counts"]).otherwise(
                F.transform(
                    acc["counts"],
                    lambda c, j: c + (j + 1 == came).cast("int") - (j + 1 == went).cast("int"),
                )
            )
            best = F.when((k >= window - 1) & (total < acc["best"]), total).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        start = F.struct(zero.alias("counts"), F.lit(0).alias("total"), F.lit(TERMS[-1] + 1).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])

    def coded(c):
        return let(
            F.array_distinct(c),
            lambda alphabet: let(
                F.struct(
                    F.transform(c, lambda x: F.array_position(alphabet, x).cast("int")).alias("codes"),
                    F.size(alphabet).alias("size"),
                    F.least(F.size(c), F.lit(WINDOW)).alias("window"),
                ),
                slide,
            ),
        )

    return let(chars, coded)


def _most(candidate: Column) -> Column:
    out = F.lit(-1)
    window = F.least(F.char_length(candidate), F.lit(WINDOW)) - SHORTEST
    for kind in reversed(CLASSES):
        limits = F.array(*(F.lit(kind.most(n)) for n in range(SHORTEST, WINDOW + 1)))
        out = F.when(candidate.rlike(kind.pattern), F.get(limits, window)).otherwise(out)
    return out


def without_placeholders(candidate: Column, placeholder: str = PLACEHOLDER) -> Column:
    """The candidate, without its parts that hold a placeholder word."""

    def kept(parts):
        none = ~F.exists(parts, lambda part: part.rlike(placeholder))
        return F.when(none, candidate).otherwise(
            F.array_join(F.filter(parts, lambda part: ~part.rlike(placeholder)), "_")
        )

    return let(F.split(candidate, "[/_-]"), kept)


def is_random(candidate: Column, allowed: tuple[str, ...] = ALLOWED, placeholder: str = PLACEHOLDER) -> Column:
    def judged(value):
        plain = F.char_length(value) < SHORTEST
        plain |= ~value.rlike("[0-9]") | ~value.rlike("[A-Za-z]")
        for pattern in allowed:
            plain |= value.rlike(pattern)
        return F.when(plain, False).otherwise(least_sum(value) <= _most(value))

    return let(without_placeholders(candidate, placeholder), judged)


def _of_kind(found: Column, kind: str, keep) -> Column:
    order = KINDS.index(kind)
    spans = F.transform(
        F.filter(found, keep), lambda m: F.struct(m["start"], F.lit(order).alias("kind"), m["end"])
    )
    return F.coalesce(spans, F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)"))


def spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """All spans of a text: array of ``start, kind, end``, by start and then kind (index in KINDS)."""
    return F.array_sort(
        F.concat(
            _of_kind(matches(text, ASSIGN, 2), "assign", lambda m: F.char_length(m["part"]) >= ASSIGN_CHARS),
            _of_kind(
                matches(text, ACCESS, seek=f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}"),
                "access",
                lambda m: m["end"] - m["start"] >= ACCESS_CHARS,
            ),
            # only runs that are long enough, which start where the whole runs start
            _of_kind(matches(text, f"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}+"), "hex", lambda m: F.lit(True)),
            _of_kind(matches(text, CANDIDATE), "entropy", lambda m: is_random(m["match"], allowed)),
        )
    )


def scan(docs: DataFrame, text: str = "text", name: str = "secrets", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows with an array column of their spans."""
    return docs.withColumn(name, spans(F.coalesce(F.col(text).cast("string"), F.lit("")), allowed))


def span_list(array: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            array,
            lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _cover(line: Column, found: Column) -> Column:
    def add(acc, span):
        before = F.substring(line, acc["at"] + 1, span["start"] - acc["at"])
        fresh = span["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], before, F.lit(MARK))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], span["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        found, start, add, lambda acc: F.concat(acc["out"], F.substring(line, acc["at"] + 1, F.char_length(line)))
    )


def redact(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """The text with every secret replaced by MARK. No match crosses a line, so lines go one by one."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: let(spans(line, allowed), lambda s: _cover(line, s)))
    return F.array_join(lines, "\n")


def may_hold(text: Column) -> Column:
    """False for texts that certainly have no span."""
    seen = text.rlike(ASSIGN) | text.rlike(r"AKIA[A-Z0-9]{16}") | text.rlike("[0-9a-f]{24}")
    return seen | text.rlike(CANDIDATE)


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with secrets replaced in the text. All columns stay."""
    rows = carried(docs, doc_id, text)
    clean = F.when(may_hold(F.col("text")), redact(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("clean", clean).withColumn("changed", ~F.col("clean").eqNullSafe(F.col("text")))
    return restored(rows.withColumn("text", F.col("clean")), docs, F.col("changed"), text)
