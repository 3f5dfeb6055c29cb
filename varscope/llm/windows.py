"""Substring dedup: word windows that start in an earlier document are removed.

Method: super-k-mer partitioning. Every window of ``window`` words has a minimiser, the
smallest hash among its ``minimiser``-word grams. Consecutive windows that share it
travel as one packed string to the bucket of the minimiser. A bucket sorts its windows
by content, and so learns the smallest document of each exactly.

Scale: documents are grouped by a hash into groups of ``tasks.GROUP_BYTES`` of text. A
group sends each distinct packed string once, with its smallest document, so a passage
held by a third of all documents arrives once per group and not once per document. A
bucket answers with the smallest documents of the windows in a string, again once per
group; the group then looks up its own strings. Nothing travels per occurrence.

A cell packs a row for each bucket it has strings for: the cells times the buckets, but
never more than the strings. A minimiser whose strings hold more than ``group_bytes`` over
all documents is hot: words around a frequent phrase differ between documents, so folding
does not bound its bucket. The list of hot minimisers, that all tasks get, is bounded by
``MOST_HOT``: with more text than ``MOST_HOT`` times half a group, what counts as hot grows.
Windows of hot minimisers travel one by one to the bucket of their whole content. Equal
windows have equal minimisers, so they still meet. Rows repeated so often that they
outgrow a group are folded to one row and given back at the end.

Defined results. A null or empty text has no words. A document without ``doc_id``
neither loses words nor takes any from others. Rows that share a ``doc_id`` are one
document for the comparison and keep a row each. A window that repeats only within its
own document stays. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscope.llm.blocks import (
    U,
    Words,
    blocks,
    find_words,
    gather,
    mix,
    ngrams,
    ranges,
    sliding_min,
    span_hash,
    span_ids,
    text_bytes,
    to_strings,
    within,
)
from varscope.llm.tasks import GROUP_BYTES, folded, group_of, groups_for, text_rows, total_bytes, unfolded

WINDOW = 13
MINIMISER = 3
# A run of windows is cut here, so that a text of one repeated word makes no endless string.
RUN_WINDOWS = 64
# Text whose minimisers are counted together before the frequent ones leave a task.
COUNTED_BYTES = 64 << 20
NO_HOT = np.zeros(0, U)
# Hot minimisers that the tasks know; over that many, a minimiser must be larger to be hot.
MOST_HOT = 1_000_000
COMPRESSED_FROM = 512
# Bytes of strings for each byte of text, at most: a window lies in few strings.
HOT_SHARE = 4

STRINGS = "bucket int, cell int, strings binary"
ANSWERS = "cell int, answers binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string, copies long"


_compressor, _decompressor = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one group as bytes: their sizes, then their values; compressed if that is worth it.

    A cell packs a row for each bucket it has strings for, so at very large scale a row
    holds a single string: it must cost little more than that.
    """
    parts = [v.tobytes() for v in arrays.values()]
    plain = struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)
    return b"\0" + plain if len(plain) < COMPRESSED_FROM else b"\1" + _compressor.compress(plain)


def unpack(packed: bytes, **kinds: type) -> list[np.ndarray]:
    """The arrays again; ``kinds`` names all of them, in the order they were packed in."""
    plain = _decompressor.decompress(packed[1:]) if packed[:1] == b"\1" else packed[1:]
    at, out = 4 * len(kinds), []
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}I", plain), kinds.values()):
        out.append(np.frombuffer(plain, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in ``some``, a sorted array."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def runs(
    words: Words, h: np.ndarray, has_id: np.ndarray, window: int, minimiser: int, hot: np.ndarray = NO_HOT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each run; a hot minimiser's have one window."""
    least = sliding_min(ngrams(h, minimiser), window - minimiser + 1)
    valid = within(words, window)
    valid &= has_id[words.doc[: len(valid)]]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    position = np.arange(len(valid))
    begun = np.maximum.accumulate(np.where(new, position, 0))
    new |= valid & ((position - begun) % RUN_WINDOWS == 0)
    new |= valid & among(least, hot)
    start = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    # windows of each run; runs lie in `valid` stretches only
    length = np.bincount(number[valid], minlength=len(start)) if len(start) else start
    return start, length, least[start]


class Strings:
    """The distinct packed strings of one group of documents."""

    def __init__(self, words: Words, doc_ids: np.ndarray, has_id: np.ndarray, window: int, minimiser: int, hot: np.ndarray = NO_HOT):
        self.words, self.window = words, window
        h = span_hash(words.data, words.start, words.end)
        self.start, self.length, self.least = start, _, _ = runs(words, h, has_id, window, minimiser, hot)
        self.doc = doc_ids[words.doc[start]] if len(start) else start
        content = ngrams(h, window)
        at = ranges(start, self.length)
        offset = (at - np.repeat(start, self.length)).astype(U)
        key = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            terms = mix(content[at] + offset * U(seed))
            starts = np.cumsum(self.length) - self.length
            key.append(np.add.reduceat(terms, starts) if len(start) else terms)
        order = np.lexsort((self.doc, key[1], key[0]))
        first = np.ones(len(order), bool)
        first[1:] = (key[0][order][1:] != key[0][order][:-1]) | (key[1][order][1:] != key[1][order][:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        self.run = order[heads]  # a run for each distinct string, of its smallest document
        last = np.append(heads[1:], len(order)) - 1 if len(order) else heads
        self.shared = self.doc[order[last]] != self.doc[self.run]
        # what equal windows share: their minimiser, or all of their words if it is hot
        self.key = np.where(among(self.least[self.run], hot), key[0][self.run], self.least[self.run])

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        bucket = (mix(self.key) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(order))):
            number = order[lo:hi]
            run = self.run[number]
            begin = self.words.start[self.start[run]]
            end = self.words.end[self.start[run] + self.length[run] + self.window - 2]
            text, offsets = gather(self.words.data, begin, end)
            yield int(bucket[number[0]]), pack(
                number=np.diff(number, prepend=0).astype(np.int32),
                doc=self.doc[run],
                shared=self.shared[number],
                size=np.diff(offsets).astype(np.int32),
                text=text,
            )


def group_strings(
    table: pa.Table, window: int, minimiser: int, hot: np.ndarray = NO_HOT
) -> tuple[Strings, pa.Table]:
    """The strings of a group; the rows are put in an order that does not depend on their arrival."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    data, offsets = text_bytes(table.column("text"))
    ids = table.column("doc_id")
    has_id = np.asarray(ids.is_valid())
    doc_ids = np.asarray(ids.fill_null(0), np.int64)
    return Strings(find_words(data, offsets), doc_ids, has_id, window, minimiser, hot), table


def smallest_documents(words: Words, doc: np.ndarray, window: int):
    """For each window of the strings: its start word, and the smallest document that has it."""
    ids, _ = span_ids(words.data, words.start, words.end)
    at = np.flatnonzero(within(words, window))
    h = ngrams(mix(ids.astype(U) + U(1)), window)[at]
    owner = doc[words.doc[at]]
    order = np.lexsort((owner, h))
    equal = h[order][1:] == h[order][:-1]
    a, b = at[order][1:][equal], at[order][:-1][equal]
    for k in range(window):
        if (ids[a + k] != ids[b + k]).any():  # two contents with one hash: sort by the words themselves
            order = np.lexsort((owner, *(ids[at + j] for j in range(window))))
            one, other = at[order][1:], at[order][:-1]
            equal = np.all([ids[one + j] == ids[other + j] for j in range(window)], axis=0)
            break
    new = np.concatenate([[True], ~equal])[: len(order)]
    least = np.empty(len(order), np.int64)
    least[order] = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return at, least


def bucket_answers(table: pa.Table, window: int) -> Iterator[tuple[int, bytes]]:
    cells = np.asarray(table.column("cell"), np.int64)
    order = np.argsort(cells, kind="stable")
    parts = [
        unpack(table.column("strings")[int(i)].as_py(), number=np.int32, doc=np.int64, shared=bool, size=np.int32, text=np.uint8)
        for i in order
    ]
    sizes = np.concatenate([p[3] for p in parts]).astype(np.int64)
    words = find_words(np.concatenate([p[4] for p in parts]), np.concatenate([[0], np.cumsum(sizes)]))
    doc = np.concatenate([p[1] for p in parts])
    at, least = smallest_documents(words, doc, window)
    per_string = np.diff(words.first) - window + 1
    starts = np.cumsum(per_string) - per_string
    earlier = np.minimum.reduceat(least, starts) < doc
    wanted = earlier | np.concatenate([p[2] for p in parts])
    before = 0
    for cell_row, part in zip(order, parts):
        n = len(part[1])
        mine = np.flatnonzero(wanted[before : before + n])
        if len(mine):
            windows = per_string[before + mine]
            yield int(cells[cell_row]), pack(
                number=np.cumsum(part[0])[mine].astype(np.int32),
                windows=windows.astype(np.int32),
                least=least[ranges(starts[before + mine], windows)],
            )
        before += n


def covered(length: int, start: np.ndarray, size: int) -> np.ndarray:
    """Which of ``length`` words lie in a window of ``size`` words from one of the starts."""
    change = np.bincount(start, minlength=length + 1) - np.bincount(start + size, minlength=length + 1)
    return np.cumsum(change)[:length] > 0


def keep_words(words: Words, offsets: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that stay, joined by one space in each document."""
    doc = words.doc[~removed]
    start, end = words.start[~removed], words.end[~removed]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    # a word that another follows has white space after it: it serves as the space
    data = np.where(np.isin(words.data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)), np.uint8(32), words.data)
    text, _ = gather(data, start, end + ~last)
    length = np.bincount(doc, weights=end - start + ~last, minlength=len(offsets) - 1).astype(np.int64)
    return text, np.concatenate([[0], np.cumsum(length)])


def apply_answers(
    docs: pa.Table, answers: pa.Table, window: int, minimiser: int, hot: np.ndarray = NO_HOT
) -> pa.Table:
    strings, docs = group_strings(docs, window, minimiser, hot)
    words = strings.words
    removed = np.zeros(len(words), bool)
    if answers.num_rows and len(strings.run):
        parts = [
            unpack(x.as_py(), number=np.int32, windows=np.int32, least=np.int64) for x in answers.column("answers")
        ]
        number, windows, least = (np.concatenate(x) for x in zip(*parts))
        place = np.full(len(strings.run), -1)
        place[number] = np.arange(len(number))
        begins = np.cumsum(windows) - windows
        answered = np.flatnonzero(place[strings.number] >= 0)
        answer = place[strings.number[answered]]
        length = strings.length[answered]
        at = ranges(strings.start[answered], length)
        found = least[ranges(begins[answer], length)]
        removed = covered(len(words), at[found < np.repeat(strings.doc[answered], length)], window)
    _, offsets = text_bytes(docs.column("text"))
    text, kept = keep_words(words, offsets, removed)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(words.counts(), pa.int64()),
            "n_removed": pa.array(np.bincount(words.doc[removed], minlength=docs.num_rows), pa.int64()),
            "kept_text": to_strings(text, kept, pa.string()),
            "copies": docs.column("copies"),
        }
    )


def hot_minimisers(rows: DataFrame, total: int, window: int, minimiser: int, hot_bytes: int) -> np.ndarray:
    """Sorted minimisers; all whose strings hold ``hot_bytes`` or more are among them.

    A task passes on the minimisers that hold their share of half of ``hot_bytes`` in the
    text it has read. What it keeps back adds up to less than the other half.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = [], 0

        def frequent() -> pa.RecordBatch:
            least, size = (np.concatenate(x) for x in zip(*parts))
            found, number = np.unique(least, return_inverse=True)
            size = np.bincount(number, weights=size, minlength=len(found)).astype(np.int64)
            enough = size >= hot_bytes / 2 * seen / total
            columns = [pa.array(found[enough].view(np.int64)), pa.array(size[enough])]
            return pa.RecordBatch.from_arrays(columns, ["minimiser", "size"])

        for block in blocks(batches, "text"):
            data, offsets = text_bytes(block.column("text"))
            words = find_words(data, offsets)
            has_id = np.asarray(block.column("doc_id").is_valid())
            start, length, least = runs(
                words, span_hash(words.data, words.start, words.end), has_id, window, minimiser
            )
            parts.append((least, words.end[start + length + window - 2] - words.start[start]))
            seen += len(data)
            if seen >= COUNTED_BYTES:
                yield frequent()
                parts, seen = [], 0
        if seen:
            yield frequent()

    counted = rows.select("doc_id", "text").mapInArrow(count, "minimiser long, size long")
    hot = counted.groupBy("minimiser").agg(F.sum("size").alias("size")).where(F.col("size") >= hot_bytes / 2)
    return np.sort(np.array([r[0] for r in hot.select("minimiser").collect()], np.int64).view(U))


def dedup_substrings(
    docs: DataFrame,
    window: int = WINDOW,
    minimiser: int = MINIMISER,
    doc_id: str = "doc_id",
    text: str = "text",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text``.

    A word is removed if a window over it also starts in a document with a smaller id.
    """
    rows = folded(text_rows(docs, doc_id, text), group_bytes)
    total = total_bytes(rows, "text")
    groups = groups_for(total, group_bytes)
    hot = hot_minimisers(rows, total, window, minimiser, max(group_bytes, -(-2 * HOT_SHARE * total // MOST_HOT)))
    rows = rows.withColumn("cell", group_of(groups, "doc_id", "text"))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        strings, _ = group_strings(table, window, minimiser, hot)
        rows = list(strings.by_bucket(groups)) if len(strings.run) else []
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "cell": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "strings": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        rows = list(bucket_answers(table, window))
        return pa.table(
            {
                "cell": pa.array([r[0] for r in rows], pa.int32()),
                "answers": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_batches([], pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("copies", pa.int64())]))
        return apply_answers(docs, answers, window, minimiser, hot)

    by_cell = rows.groupBy("cell")
    strings = by_cell.applyInArrow(send, STRINGS)
    answers = strings.groupBy("bucket").applyInArrow(answer, ANSWERS)
    return unfolded(by_cell.cogroup(answers.groupBy("cell")).applyInArrow(finish, KEPT))
