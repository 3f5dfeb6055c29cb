"""Language identification by averaged subword embeddings.

Method: a text is the average of the embeddings of its subwords, byte n-grams of words
with their borders, hashed into buckets. A linear softmax over the average gives the
language. Embeddings and weights are trained together by stochastic gradient descent in
NumPy, on spans of many lengths of a bounded sample. A part of the sample is held back:
on it the temperature of the softmax is fitted, and the score from which a prediction is
accepted, so that accepted predictions err at most at a stated rate (calibrated rejection).

Scale: the sample has at most ``PER_LANGUAGE`` pieces of ``PIECE_CHARS`` characters for
each of at most ``LANGUAGES`` languages, whatever the size of the table; this is the only
text that the driver sees. It is drawn by a hash threshold that follows from counts over
all rows. Prediction reads each whole text once, in vectorised blocks, with no shuffle; the
model is ``BUCKETS`` rows of numbers and is broadcast. Sums over subwords are additive, so
a long text is scored in steps.

Defined results. A text that is null, empty or has no letter is ``und`` with score 0 and is
not accepted; so is any text if nothing was learned. Rows are independent: repeated rows
and ids need no rule, other columns pass through. Rows with a null text or language teach
nothing. Of an empty table the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varscope.llm.blocks import U, blocks, eight_bytes, mix, ranges, text_bytes

UNKNOWN = "und"
BUCKETS = 1 << 16
DIMENSIONS = 16
# Lengths of subwords in bytes.
SIZES = (2, 3, 4)

# What is learned from: a bounded sample of labelled rows.
LANGUAGES = 200
PER_LANGUAGE = 300
PIECE_CHARS = 1500
HELD_BACK = 5  # every fifth piece calibrates

EPOCHS = 6
SPANS = 64  # in one step of the descent
RATE = 1.0
LEAST_SPAN, MOST_SPAN = 20, 800
ERROR_RATE = 0.01

# Positions scored in one step.
STEP_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20

PREDICTED = "struct<lang: string, score: double, accepted: boolean>"
_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

# ASCII letters stay as lower case; other ASCII is a border; bytes of other characters stay.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


# ---------------------------------------------------------------------------- subwords


def folded_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with a border before and after each text, text that owns each byte)."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    out = np.full(len(data) + n + 1, 0x20, np.uint8)
    owner = np.repeat(np.arange(n), lengths + 1)
    inside = np.ones(len(owner), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    out[1:][inside] = _FOLD[data]
    return out, np.concatenate([[0], owner])


def subwords(data: np.ndarray, lo: int, hi: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(second positions, buckets) of the subwords of each size that begin in lo..hi.

    A border may only stand at the ends of a subword. The second byte always belongs to
    the text, or is the border right after it.
    """
    part = np.zeros(min(hi + max(SIZES), len(data)) - lo + 8, np.uint8)
    part[: len(part) - 8] = data[lo : lo + len(part) - 8]
    size = len(part) - 8
    letter = part[:size] != 0x20
    value = eight_bytes(part)
    for n in SIZES:
        count = min(hi - lo, size - n + 1)
        if count <= 0:
            continue
        good = letter[:count] | letter[1 : 1 + count]
        for k in range(1, n - 1):
            good = good & letter[k : k + count]
        at = np.flatnonzero(good)
        key = mix(value[at] & U((1 << (8 * n)) - 1))
        yield lo + at + 1, (key % U(buckets)).astype(np.int64)


# ---------------------------------------------------------------------------- training


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Trainer:
    """Stochastic gradient descent on spans of texts."""

    def __init__(self, n_classes: int, buckets: int, dimensions: int, seed: int):
        self.random = np.random.default_rng(seed)
        self.embeddings = self.random.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
        self.weights = np.zeros((dimensions, n_classes), np.float32)
        self.bias = np.zeros(n_classes, np.float32)

    def average(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.embeddings[ids], np.cumsum(size) - size, axis=0) / size[:, None]

    def step(self, ids: np.ndarray, size: np.ndarray, classes: np.ndarray, rate: float) -> None:
        """One step on spans with ``size`` subwords each, their buckets one after the other."""
        mean = self.average(ids, size)
        error = softmax(mean @ self.weights + self.bias)
        error[np.arange(len(classes)), classes] -= 1
        back = (error @ self.weights.T) / size[:, None]
        order = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.diff(ids[order], prepend=-1))
        span = np.repeat(np.arange(len(size)), size)[order]
        # gradients are summed over the spans; only the bias, which all of them share, takes the mean
        self.embeddings[ids[order][heads]] -= (rate * np.add.reduceat(back[span], heads, axis=0)).astype(np.float32)
        self.weights -= (rate * (mean.T @ error)).astype(np.float32)
        self.bias -= (rate * error.mean(axis=0)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Per bucket what it adds to the logits, and how scores are read."""

    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    accept_from: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probabilities, one row per text."""
        data, owner = folded_bytes(*text_bytes(column))
        n, n_classes = len(column), len(self.languages)
        total, count = np.zeros((n, n_classes)), np.zeros(n)
        for lo in range(0, len(data), STEP_BYTES):
            for at, bucket in subwords(data, lo, min(lo + STEP_BYTES, len(data)), len(self.table)):
                of = owner[at]
                count += np.bincount(of, minlength=n)
                for k in range(n_classes):
                    total[:, k] += np.bincount(of, weights=self.table[bucket, k], minlength=n)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)

    def predict(self, column: pa.Array) -> pa.StructArray:
        known = np.asarray(column.is_valid())
        p = self.scores(column)
        best = p.argmax(axis=1)
        score = np.where(known, np.round(p[np.arange(len(p)), best], 9), 0.0)
        names = np.array([*self.languages, UNKNOWN], object)[np.where(known, best, len(self.languages))]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(score), pa.array(known & (score >= self.accept_from))], fields=list(_KIND)
        )


def train(
    texts: list[str],
    labels: list[str],
    buckets: int = BUCKETS,
    dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS,
    error_rate: float = ERROR_RATE,
    seed: int = 0,
) -> Model | None:
    """A model of the pieces, which are lower case. None if there are none with a subword."""
    languages = tuple(sorted(set(labels)))
    data, owner = folded_bytes(*text_bytes(pa.array(texts, pa.string())))
    found = list(subwords(data, 0, len(data), buckets))
    if not found or not sum(len(at) for at, _ in found):
        return None
    at, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    at, ids = at[order], ids[order]
    first = np.searchsorted(owner[at], np.arange(len(texts) + 1))
    size = np.diff(first)
    classes = np.array([languages.index(x) for x in labels])
    usable = np.flatnonzero(size > 0)
    held = usable[np.arange(len(usable)) % HELD_BACK == HELD_BACK - 1]
    learned = np.setdiff1d(usable, held)
    trainer = Trainer(len(languages), buckets, dimensions, seed)

    def spans(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a random span of each piece, and how many."""
        length = trainer.random.integers(LEAST_SPAN, MOST_SPAN + 1, len(pieces)) * len(SIZES)
        length = np.minimum(length, size[pieces])
        begin = first[pieces] + (trainer.random.random(len(pieces)) * (size[pieces] - length + 1)).astype(np.int64)
        return ids[ranges(begin, length)], length

    steps = epochs * -(-len(learned) // SPANS)
    done = 0
    for _ in range(epochs):
        shuffled = trainer.random.permutation(learned)
        for k in range(0, len(shuffled), SPANS):
            batch = shuffled[k : k + SPANS]
            trainer.step(*spans(batch), classes[batch], RATE * (1 - done / steps))
            done += 1
    table = trainer.embeddings @ trainer.weights
    temperature, accept_from = calibrated(trainer, *(spans(held) if len(held) else (None, None)), classes[held], error_rate)
    return Model(languages, np.ascontiguousarray(table), trainer.bias, temperature, accept_from)


def calibrated(trainer: Trainer, ids, size, classes: np.ndarray, error_rate: float) -> tuple[float, float]:
    """(temperature of least log loss, lowest score whose predictions err at most at the rate)."""
    if not len(classes):
        return 1.0, 0.5
    logits = trainer.average(ids, size) @ trainer.weights + trainer.bias
    losses = {}
    for temperature in np.geomspace(0.05, 20, 60):
        p = softmax(logits / temperature)
        losses[float(temperature)] = -np.log(p[np.arange(len(p)), classes] + 1e-12).mean()
    temperature = min(losses, key=losses.get)
    p = softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == classes
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(errors <= error_rate)
    return temperature, float(score[order[good[-1]]]) if len(good) else 1.0


def sample(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    piece_chars: int = PIECE_CHARS,
    languages: int = LANGUAGES,
) -> tuple[list[str], list[str]]:
    """(pieces of texts, their languages): texts with the smallest hashes of each language.

    A hash threshold from the counts of all rows leaves little more than the sample, so
    nothing of a frequent language is gathered. Copies of a text are one. A piece begins at
    a place that the hash names.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where((F.length("text") > 0) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return [], []
    bound = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, 1.5 * per_language / r["count"])) for r in counts], "lang string, share double"
    )
    spread = F.pmod(F.col("key"), F.lit(1 << 30)) / (1 << 30)
    near = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(bound), "lang").where(spread <= F.col("share"))
    start = (F.pmod(F.xxhash64("key"), F.greatest(F.char_length("text") - piece_chars, F.lit(0)) + 1) + 1).cast("int")
    piece = F.lower(F.substring("text", start, F.lit(piece_chars)))
    pieces = near.select("lang", "key", piece.alias("piece")).groupBy("lang", "key").agg(F.min("piece").alias("piece"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    found = ranked.where(F.col("rank") <= per_language).collect()
    found = sorted((r["lang"], r["rank"], r["piece"]) for r in found)
    return [r[2] for r in found], [r[0] for r in found]


# ---------------------------------------------------------------------------- prediction


def predict(text: Column, model: Model, spark) -> Column:
    """Struct of ``lang``, ``score``, ``accepted`` for a whole text."""
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [shared.value.predict(b.column(0)) for b in blocks(iter([rows]), "text", BLOCK_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _KIND)

    return F.arrow_udf(run, PREDICTED)(text)


def identify(docs: DataFrame, model: Model | None, text: str = "text", name: str = "language") -> DataFrame:
    """The rows with a struct column ``name``: ``lang``, ``score`` and ``accepted``."""
    lettered = F.when(F.col(text).cast("string").rlike(r"\p{L}"), F.lower(F.col(text).cast("string")))
    if model is None:
        none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
        return docs.withColumn(name, none)
    return docs.withColumn(name, predict(lettered, model, docs.sparkSession))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", **options) -> Model | None:
    """A model of the labelled rows."""
    texts, labels = sample(docs, text, lang)
    return train(texts, labels, **options) if texts else None
