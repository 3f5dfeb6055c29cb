"""N-gram Jaccard join of documents, with Bayesian pruning of the candidates.

Method. Texts become sets of word ``n``-grams; MinHash bands name candidate pairs. For a
candidate the MinHash values are compared ``STEP`` at a time. After each step the
posterior probability that the similarity reaches the threshold, given the matches so
far and a uniform prior, is P(Binomial(compared + 1, threshold) <= matches); the pair is
dropped once that falls below ``TOLERANCE``. What remains is verified exactly.

Scale. Equal texts are folded to one representative first, so a text held by a third of
all documents is one row. Pairs are never rows: a bucket of a band is compared inside a
task, in blocks of at most ``BLOCK`` members if it is larger, and only a spanning forest of
its surviving pairs leaves the task. The connected survivors are then verified, again
block against block, by exact set intersections; a task gives per member the number of
links, and a spanning forest. Of a component of more than one block only the pairs of
blocks that hold a surviving pair are verified, so the work follows the survivors: a chain
of near copies costs its length, a family whose members are all alike the square of their
number, as it has as many links. Text is shuffled for the verification only.

Recall. A pair at the threshold 0.8 misses all 24 bands of 4 values with probability
3e-6, and is pruned with probability of about ``TOLERANCE`` per step; a pair below the
threshold is never a link.

Defined results. A text of fewer than ``n`` words has one n-gram, all its words; a null
or empty text (no words) has no links. Words are cut at ASCII white space and compared
as they are. Equal rows are linked to each other. Rows without ``doc_id`` are linked
like others, but do not name a class unless no other member has an id. Other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.llm.blocks import U, blocks, find_words, mix, ngrams, span_hash, text_bytes, to_strings, within
from varscope.llm.components import components
from varscope.llm.tasks import carried, restored, text_rows
from varscope.operators.joins import join_heavy
from varscope.session import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, PER_BAND = 24, 4
HASHES = BANDS * PER_BAND
STEP = 8
TOLERANCE = 1e-7
BLOCK = 256
GRAMS_IN_BLOCK = 400_000
# Pairs that one vectorised step compares, and cells of its exact verification.
PAIRS_AT_ONCE = 1 << 18
CELLS_AT_ONCE = 1 << 22

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=U))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the word n-grams of all texts, offsets by text), repeats included."""
    data, offsets = text_bytes(column)
    words = find_words(data, offsets)
    if not len(words):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    h = span_hash(words.data, words.start, words.end)
    counts = words.counts()
    whole = np.flatnonzero(within(words, n))
    value, doc = [ngrams(h, n)[whole]], [words.doc[whole]]
    for k in range(1, n):  # short texts: one n-gram of all words
        short = np.flatnonzero(counts == k)
        if len(short):
            value.append(ngrams(h, k)[words.first[short]] + U(k))
            doc.append(short)
    value, doc = np.concatenate(value), np.concatenate(doc)
    order = np.argsort(doc, kind="stable")
    return value[order], np.searchsorted(doc[order], np.arange(len(offsets)))


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of the texts that have any n-gram: one row per hash function."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((HASHES, len(starts)), U)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((value ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | U(1)), starts)
    return out


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            value, offsets = shingles(block.column("text"), n)
            some = np.diff(offsets) > 0
            if not some.any():
                continue
            least = signatures(value, offsets)
            bands = np.zeros((some.sum(), BANDS), U)
            for band in range(BANDS):
                h = np.full(bands.shape[0], band + 1, U)
                for k in range(PER_BAND):
                    h = mix(h * U(0x9E3779B97F4A7C15) + least[band * PER_BAND + k])
                bands[:, band] = h
            short = np.ascontiguousarray((least >> U(48)).astype("<u2").T)
            rows = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("node").filter(rows),
                    pa.ListArray.from_arrays(
                        np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel())
                    ),
                    to_strings(
                        short.view(np.uint8).ravel(), np.arange(0, short.nbytes + 1, 2 * HASHES), pa.binary()
                    ),
                    pa.array(np.diff(offsets)[some]),
                ],
                ["node", "bands", "signature", "grams"],
            )

    return run


def needed_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(compared, matches a pair needs to stay) after each step."""
    out = []
    for compared in range(STEP, HASHES + 1, STEP):
        trials, below, matches = compared + 1, 0.0, 0
        while matches <= compared:
            below += math.comb(trials, matches) * threshold**matches * (1 - threshold) ** (trials - matches)
            if below >= tolerance:
                break
            matches += 1
        out.append((compared, matches))
    return out


def surviving(signature: np.ndarray, a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (a, b) of rows stay after all steps."""
    open_, matches, before = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for compared, least in needed:
        left, right = signature[a[open_], before:compared], signature[b[open_], before:compared]
        matches[open_] += (left == right).sum(1, dtype=np.int32)
        open_ = open_[matches[open_] >= least]
        before = compared
    return open_


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member each of ``size`` members is connected with by the pairs."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        different = label[a] != label[b]
        a, b = a[different], b[different]
    while True:
        jumped = label[label]
        if (jumped == label).all():
            return label
        label = jumped


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, in tables of whole groups of about ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = group_starts(table, keys)
        if len(change) > 1:
            yield table.slice(0, change[-1])
            held = table.slice(change[-1]).to_batches()
        else:
            held = table.to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = np.asarray(table.column(key))
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def pair_steps(starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside the groups [start, end), about ``limit`` at a time."""
    sizes = ends - starts
    row = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = np.repeat(ends, sizes) - row - 1  # partners after each row
    total = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        a = np.repeat(row[at:end], later[at:end])
        before = np.repeat(total[at:end] - total[at], later[at:end])
        yield a, a + 1 + np.arange(len(a)) - before
        at = end


def _survivors(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float):
    """(table of whole buckets, rows of one member, rows of the other) of the pairs that stay."""
    needed = needed_matches(threshold, tolerance)
    for table in grouped(batches, ["band", "i", "j"], 20_000):
        starts = group_starts(table, ["band", "i", "j"])
        ends = np.append(starts[1:], table.num_rows)
        data, _ = text_bytes(table.column("signature"))
        signature = data.view("<u2").reshape(-1, HASHES)
        a, b = [], []
        for left, right in pair_steps(starts, ends, PAIRS_AT_ONCE):
            stay = surviving(signature, left, right, needed)
            a.append(left[stay])
            b.append(right[stay])
        yield table, np.concatenate(a), np.concatenate(b)


def _compare(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, a, b in _survivors(batches, threshold, tolerance):
            label = forest(table.num_rows, a, b)
            member = np.flatnonzero(label != np.arange(len(label)))
            node = table.column("node")
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(label[member])).combine_chunks(), node.take(pa.array(member)).combine_chunks()],
                ["a", "b"],
            )

    return run


def _compare_blocks(threshold: float, tolerance: float):
    """Pairs of blocks of the verification that hold a surviving pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, a, b in _survivors(batches, threshold, tolerance):
            block, roots = np.asarray(table.column("block"), np.int64), table.column("root").combine_chunks()
            low, high = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
            root = np.asarray(roots.dictionary_encode().indices, np.int64)  # survivors have one root
            _, once = np.unique(np.stack([root[a], low, high]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [roots.take(pa.array(a[once])), pa.array(low[once], pa.int32()), pa.array(high[once], pa.int32())],
                ["root", "i", "j"],
            )

    return run


def in_blocks(members: DataFrame, group: str, size: str, by: str) -> DataFrame:
    """Copies of the members for each pair (i, j) of blocks of their group that they belong to."""
    n_blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(by), n_blocks).cast("int")
    copies = members.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), n_blocks - 1))
    )
    return copies.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def buckets(signed: DataFrame, *more: str) -> DataFrame:
    """Members of every band bucket of more than one, by pairs of blocks, ready to be compared."""
    banded = signed.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    members = banded.join(shared, "band").join(signed.select("node", "signature", *more), "node")
    blocked = in_blocks(members, "band", "members", "node")
    return (
        blocked.select("band", "i", "j", "node", "signature", *more)
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
    )


def candidates(signed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges ``a, b`` that connect the representatives of every surviving pair."""
    return buckets(signed).mapInArrow(_compare(threshold, tolerance), "a binary, b binary")


def surviving_blocks(signed: DataFrame, members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``root, i, j``: the pairs of blocks to verify. ``members`` has ``node, root, block, blocks``."""
    large = members.filter("blocks > 1").select("node", "root", "block")
    compared = buckets(signed.join(large, "node"), "root", "block")
    some = compared.mapInArrow(_compare_blocks(threshold, tolerance), "root binary, i int, j int").distinct()
    small = members.filter("blocks = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j")).distinct()
    return some.unionByName(small)


def similar(values: list[np.ndarray], threshold: float) -> np.ndarray:
    """Square matrix: whether the Jaccard similarity of two sets reaches the threshold, exactly."""
    n = len(values)
    sizes = np.array([len(v) for v in values])
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(n), sizes)
    columns, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float64)
    width = max(1, CELLS_AT_ONCE // n)
    for first in range(0, len(columns), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        present = np.zeros((n, min(width, len(columns) - first)), np.float32)
        present[owner[lo:hi], column[lo:hi] - first] = 1
        common += present @ present.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * union - 1e-9


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["root", "i", "j"], 1):
            starts = group_starts(table, ["root", "i", "j"])
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
                yield verified(table.slice(lo, hi - lo), n, threshold)

    return run


def verified(table: pa.Table, n: int, threshold: float) -> pa.RecordBatch:
    """Links of one pair of blocks: per member their number, and the member it hangs on."""
    nodes = np.array(table.column("node").to_pylist(), object)
    _, once = np.unique(nodes, return_index=True)  # repeated rows
    table, nodes = table.take(pa.array(once)), nodes[once]
    value, offsets = shingles(table.column("text").combine_chunks(), n)
    sets = [np.unique(value[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    linked = similar(sets, threshold)
    np.fill_diagonal(linked, False)
    own, i, j = (np.asarray(table.column(c)) for c in ("own", "i", "j"))
    # two different blocks: pairs inside one of them belong to that block's own group
    wanted = (own[:, None] != own[None, :]) | (i == j)[:, None]
    linked &= wanted
    weight = np.asarray(table.column("copies"))
    a, b = np.nonzero(np.triu(linked))
    label = forest(len(nodes), a, b)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(nodes), pa.binary()),
            pa.array(linked @ weight, pa.int64()),
            pa.array([nodes[k] for k in label], pa.binary()),
        ],
        ["node", "links", "hangs_on"],
    )


def node_of(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    hashes = [F.lpad(F.hex(F.xxhash64(*x)), 16, "0") for x in ((text,), (F.lit(1), text))]
    return F.unhex(F.concat(*hashes))


def verify(
    rows: DataFrame, connected: DataFrame, signed: DataFrame, n: int, threshold: float, tolerance: float
) -> DataFrame:
    """``node, links, hangs_on`` from the texts of connected representatives."""
    sizes = connected.groupBy("root").agg(F.count("*").alias("members"), F.sum("grams").alias("all_grams"))
    # blocks of bounded text as well as of bounded count
    count = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("all_grams") / GRAMS_IN_BLOCK))
    members = materialize(
        connected.join(sizes.select("root", count.cast("int").alias("blocks")), "root")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    pairs = surviving_blocks(signed, members, threshold, tolerance)
    sides = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    needed = members.join(pairs.withColumn("block", F.explode(sides)), ["root", "block"])
    found = rows.join(
        needed.withColumnRenamed("node", "_node"),
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("_node")),
    )
    blocked = found.select("root", "i", "j", F.col("block").alias("own"), "node", "copies", "text")
    parts = blocked.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return parts.mapInArrow(_verify(n, threshold), "node binary, links long, hangs_on binary")


def classes(
    rows: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows ``doc_id, node, text``: (``doc_id, node`` of every row, row counts per node, classes per node).

    The last has ``node, root, first_id, copies, class_id, links`` for every node; ``root``
    is null for texts without words.
    """
    ids = materialize(rows.select("doc_id", "node"))
    nodes = materialize(ids.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    schema = "node binary, bands array<long>, signature binary, grams long"
    signed = materialize(rows.select("node", "text").mapInArrow(_signed(n), schema).dropDuplicates(["node"]))
    worded = signed.select("node", "grams").join(nodes, "node")

    connected = worded.join(components(candidates(signed, threshold, tolerance)), "node")
    checked = materialize(verify(rows, connected, signed, n, threshold, tolerance))
    linked = components(checked.filter("node <> hangs_on"), "node", "hangs_on")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))

    placed = worded.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("class_id"))
    per_node = (
        nodes.join(placed.select("node", "root"), "node", "left").join(named, "root", "left").join(links, "node", "left")
    )
    return ids, nodes, per_node


def with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", node_of(F.coalesce("text", F.lit(""))))


def near_duplicates(
    docs: DataFrame,
    n: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest id among documents connected by links, ``n_links`` the
    number of rows linked with this one, equal texts included, ``n_copies`` the number of
    rows of equal text.
    """
    ids, nodes, per_node = classes(with_node(text_rows(docs, doc_id, text)), n, threshold, tolerance)
    found = join_heavy(ids, per_node.drop("first_id"), ["node"], nodes, "copies")
    has_words = F.col("root").isNotNull()
    return found.select(
        "doc_id",
        F.when(has_words, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has_words, F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        .otherwise(F.lit(0))
        .cast("long")
        .alias("n_links"),
        F.col("copies").alias("n_copies"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows again, of each class only one: that of its smallest id. All columns stay.

    A row that repeats the kept one, id and text alike, goes as well. Rows without words
    all stay.
    """
    rows = with_node(carried(docs, doc_id, text))
    _, _, per_node = classes(rows)
    kept = (
        per_node.filter("root is not null and first_id <=> class_id")
        .groupBy("root")
        .agg(F.min_by(F.struct("node", "first_id"), "node").alias("kept"))
        .select(F.col("kept.node").alias("_node"), F.col("kept.first_id").alias("_id"))
    )
    empty = rows.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    # the id is part of the key, so that the copies of a text do not meet in one task
    chosen = rows.join(kept, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    chosen = chosen.dropDuplicates(["doc_id", "node"])
    return restored(chosen.select("text", "row").unionByName(empty.select("text", "row")), docs, text=text)
