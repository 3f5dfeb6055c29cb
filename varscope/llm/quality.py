"""Quality rules by weak supervision instead of all-must-pass filtering.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation
maximisation over the vote patterns of all documents estimates, per rule, how often it
votes against good and against bad documents, and the share of good documents. The
posterior probability of being good then replaces the conjunction of all rules.

Scale: one pass of vectorised counting over the text. The patterns are counted by a
map-side combined aggregation; at most 3 ** len(RULES) rows reach the driver, whatever
the number of documents. The posterior is a plain column expression of the counts.

Defined results. A null or empty text has no words and fails the base rules. Repeated
rows and rows without ``doc_id`` count and stay as rows of their own. Other columns pass
through, but for those whose names start with ``PREFIX``, like the added ones. Of an empty table the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.llm.blocks import SPACE, blocks, code_points, find_words, ngrams, span_hash, text_bytes
from varscope.llm.tasks import quoted

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters",
    "n_others", "n_digits", "n_marks",
)
PREFIX = "quality_"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5

# Expectation maximisation: rounds, and the first guess.
ROUNDS = 60
GOOD_SHARE = 0.8
AGAINST_GOOD = 0.003
AGAINST_BAD = 0.3
# The first guess of a rule keeps the weight of this share of the documents: the vote
# patterns alone do not say which of two groups is the good one.
PRIOR_SHARE = 0.02

_NOT_LINE_FEED = np.zeros(256, bool)
_NOT_LINE_FEED[0x0A] = True


def members(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SYMBOLS = members(b"#*$%&|<>")
UPPER = members(bytes(range(0x41, 0x5B)))
LETTERS = members(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC3, 0x100)))
DIGITS = members(bytes(range(0x30, 0x3A)))
MARKS = members(b"!?")


def chars_begin(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(before[offsets])


def repeated_words(words, h: np.ndarray, n: int = 3) -> np.ndarray:
    """Which words lie in an n-word window found twice or more in its document."""
    mask = np.zeros(len(words), bool)
    if len(words) < n:
        return mask
    at = np.flatnonzero(words.doc[: len(words) - n + 1] == words.doc[n - 1 :])
    key = ngrams(h, n)[at]
    order = np.lexsort((key, words.doc[at]))
    same = (key[order][1:] == key[order][:-1]) & (words.doc[at[order]][1:] == words.doc[at[order]][:-1])
    found = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(order) else order
    for k in range(n):
        mask[found + k] = True
    return mask


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those of them equal to an earlier one."""
    lines = find_words(data, offsets, _NOT_LINE_FEED)
    filled = np.searchsorted(words.start, lines.start)
    has_word = (filled < len(words)) & (
        words.start[np.minimum(filled, max(len(words) - 1, 0))] < lines.end if len(words) else False
    )
    start, end, doc = lines.start[has_word], lines.end[has_word], lines.doc[has_word]
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    h, other = span_hash(lines.data, start, end), span_hash(lines.data, start, end, 1)
    order = np.lexsort((other, h, doc))
    same = (h[order][1:] == h[order][:-1]) & (other[order][1:] == other[order][:-1])
    same &= doc[order][1:] == doc[order][:-1]
    return np.bincount(doc, minlength=n), np.bincount(doc[order][1:][same], minlength=n)


def count_block(column: pa.Array) -> pa.StructArray:
    data, offsets = text_bytes(column)
    words = find_words(data, offsets)
    h = span_hash(words.data, words.start, words.end) if len(words) else np.zeros(0, np.uint64)
    chars = code_points(words.data, words.start, words.end)
    n = len(offsets) - 1
    n_lines, n_dup = repeated_lines(data, offsets, words)
    repeat = repeated_words(words, h)
    values = [
        words.counts(),
        np.bincount(words.doc, weights=chars, minlength=n),
        per_document(SYMBOLS[data], offsets),
        n_lines,
        n_dup,
        np.bincount(words.doc[repeat], minlength=n),
        per_document(UPPER[data], offsets),
        per_document(LETTERS[data], offsets),
        per_document(chars_begin(data), offsets) - per_document((LETTERS | SPACE)[data], offsets),
        per_document(DIGITS[data], offsets),
        per_document(MARKS[data], offsets),
    ]
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], list(COUNTS))


def _count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        parts = [
            count_block(block.column(0))
            for block in blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text")
        ]
        yield pa.concat_arrays(parts) if parts else count_block(column)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with one long column for each of COUNTS, named ``quality_<count>``."""
    counts = F.arrow_udf(_count, "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">")
    counted = docs.withColumn(f"{PREFIX}counts", counts(F.col(text).cast("string")))
    others = [F.col(quoted(c)) for c in docs.columns if not c.startswith(PREFIX)]
    return counted.select(
        *others, *(F.col(f"{PREFIX}counts.{c}").alias(PREFIX + c) for c in COUNTS)
    )


def base_failed() -> Column:
    words, repeat = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)


@dataclass(frozen=True)
class Rule:
    """Votes for while ``100 * part <= good * whole``, against once ``100 * part > bad * whole``."""

    name: str
    part: str
    whole: str
    good: int
    bad: int

    def vote(self) -> Column:
        part, whole = 100 * F.col(PREFIX + self.part), F.col(PREFIX + self.whole)
        return (
            F.when(whole == 0, 0).when(part > self.bad * whole, -1).when(part <= self.good * whole, 1).otherwise(0)
        )


RULES = (
    Rule("long_words", "word_chars", "n_words", 900, 1200),
    Rule("symbols", "n_symbols", "n_words", 2, 10),
    Rule("symbol_characters", "n_symbols", "word_chars", 1, 4),
    Rule("letters", "n_others", "word_chars", 13, 18),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 10, 50),
    Rule("repeated_words", "n_repeat_words", "n_words", 15, 40),
    Rule("shouting", "n_upper", "n_letters", 10, 25),
    Rule("digits", "n_digits", "word_chars", 5, 15),
    Rule("marks", "n_marks", "n_words", 5, 15),
)


@dataclass(frozen=True)
class Model:
    good: float
    against_good: tuple[float, ...]
    against_bad: tuple[float, ...]

    def log_odds(self, votes: list) -> float:
        """For numbers; ``posterior`` is the same as a column."""
        total = math.log(self.good / (1 - self.good))
        for vote, g, b in zip(votes, self.against_good, self.against_bad):
            if vote:
                total += math.log(g / b) if vote < 0 else math.log((1 - g) / (1 - b))
        return total


def vote_columns() -> list[Column]:
    return [rule.vote() for rule in RULES]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """Expectation maximisation over (votes, number of documents)."""
    rules = len(RULES)
    model = Model(GOOD_SHARE, (AGAINST_GOOD,) * rules, (AGAINST_BAD,) * rules)
    if not patterns:
        return model
    votes = np.array([p for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    prior = PRIOR_SHARE * count.sum()
    for _ in range(ROUNDS):
        odds = np.array([model.log_odds(p) for p, _ in patterns])
        good = count / (1 + np.exp(-np.clip(odds, -500, 500)))
        bad = count - good

        def against(weight, guess):
            cast = ((votes != 0) * weight[:, None]).sum(0) + prior
            no = ((votes < 0) * weight[:, None]).sum(0) + prior * guess
            return no / cast

        # a rule is never believed to speak against good documents rather than bad ones
        of_good, of_bad = against(good, AGAINST_GOOD), against(bad, AGAINST_BAD)
        of_bad = np.maximum(of_bad, of_good)
        share = (good.sum() + prior * GOOD_SHARE) / (count.sum() + prior)
        model = Model(float(share), tuple(map(float, of_good)), tuple(map(float, of_bad)))
    return model


def estimate(counted: DataFrame) -> Model:
    """Fit over all rows of ``with_counts``; the documents failing the base rules take no part."""
    patterns = (
        counted.filter(~base_failed())
        .select(F.array(*vote_columns()).alias("votes"))
        .groupBy("votes")
        .count()
        .collect()
    )
    return fit(sorted((tuple(r["votes"]), r["count"]) for r in patterns))


def posterior(model: Model) -> Column:
    """Probability of good quality, from the columns of ``with_counts``."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for vote, g, b in zip(vote_columns(), model.against_good, model.against_bad):
        odds = odds + (
            F.when(vote < 0, math.log(g / b)).when(vote > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
        )
    return 1 / (1 + F.exp(-odds))


def judge(counted: DataFrame, model: Model) -> DataFrame:
    """Adds ``quality_base_failed``, ``quality_posterior`` and ``quality_kept``."""
    judged = counted.withColumn(PREFIX + "base_failed", base_failed()).withColumn(
        PREFIX + "posterior", posterior(model)
    )
    kept = ~F.col(PREFIX + "base_failed") & (F.col(PREFIX + "posterior") >= KEEP_FROM)
    return judged.withColumn(PREFIX + "kept", kept)
