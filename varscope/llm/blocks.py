"""Vectorised text helpers for Arrow tasks: many documents in one byte buffer.

A task never loops over words in Python: words, their hashes, n-grams and windows are
NumPy arrays over a block of about ``BLOCK_BYTES`` of text. Words are cut at ASCII
white space, so they can be found in the UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

# Text that one vectorised step looks at; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def to_strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow array (string or binary) over one byte buffer."""
    wide = pa.large_string() if pa.types.is_string(kind) else pa.large_binary()
    return pa.Array.from_buffers(
        wide,
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(kind)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``limit`` bytes of ``column``."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        before = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(before, before[at] + limit - size, "right")) - 1
            if end <= at and not size:
                end = at + 1
            end = max(end, at)
            if end > at:
                kept.append(batch.slice(at, end - at))
                size += int(before[end] - before[at])
            at = end
            if at < batch.num_rows:
                yield joined(kept)
                kept, size = [], 0
    if kept:
        yield joined(kept)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


@dataclass
class Words:
    """Words of a block: byte spans, document of each, first word of each document."""

    data: np.ndarray  # the block's bytes with eight zero bytes before and after
    start: np.ndarray  # positions in data
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[8 : 8 + len(data)] = data
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # first byte of each document that has any
    begins[edges] = inside[edges]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(padded, start + 8, np.flatnonzero(ends) + 9, doc, first)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit value that starts at each byte."""
    return np.ndarray((len(data) - 7,), U, data, 0, (1,))


def ends_of(data, start, end):
    """(first up to eight bytes, last up to eight bytes) of each span, as integers."""
    at = eight_bytes(data)
    length = end - start
    short = np.minimum(length, 8)
    mask = ~U(0) >> (U(64) - U(8) * short.astype(U))
    head = at[start] & mask
    tail = np.where(length >= 8, at[np.maximum(end - 8, 0)], head)
    return head, tail


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes (spans have at least one byte)."""
    length = end - start
    head, tail = ends_of(data, start, end)
    h = mix(head + U((seed * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) + tail
    h = mix(h ^ (length.astype(U) * U(0xC2B2AE3D27D4EB4F)))
    long = np.flatnonzero(length > 16)
    huge = long[length[long] > _LONG_WORD]
    long = long[length[long] <= _LONG_WORD]
    at, k = eight_bytes(data), 8
    while len(long):
        h[long] = mix(h[long] * U(0x9E3779B97F4A7C15) + at[start[long] + k])
        k += 8
        long = long[length[long] > k + 8]
    for i in huge:
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest()
        h[i] = U(int.from_bytes(digest, "little"))
    return h


def same_spans(data, start, end, i, j) -> np.ndarray:
    """Whether spans i and j (index arrays) hold the same bytes."""
    length = end[i] - start[i]
    same = length == end[j] - start[j]
    head_i, tail_i = ends_of(data, start[i], end[i])
    head_j, tail_j = ends_of(data, start[j], end[j])
    same &= (head_i == head_j) & (tail_i == tail_j)
    at, k = eight_bytes(data), 8
    open_ = np.flatnonzero(same & (length > 16))
    while len(open_):
        same[open_] &= at[start[i[open_]] + k] == at[start[j[open_]] + k]
        k += 8
        open_ = open_[same[open_] & (length[open_] > k + 8)]
    return same


def span_ids(data, start, end, h=None) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's content, a span that has the content), by content exactly."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hash(data, start, end) if h is None else h
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    if not same_spans(data, start, end, order[1:][equal], order[:-1][equal]).all():
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(data[s:e].tobytes(), len(numbers)) for s, e in zip(start, end)])
        found = np.zeros(len(numbers), np.int64)
        found[ids] = np.arange(len(ids))
        return ids, found
    new = np.concatenate([[True], ~equal])
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values; one entry per start."""
    if len(h) < n:
        return np.zeros(0, U)
    out, covered, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = len(h) - covered - size + 1
                out = mix(out[:m] * U(0x9FB21C651E98DF25) + power[covered : covered + m])
            covered += size
        if covered == n:
            return out
        power = mix(power[:-size] * U(0x9E3779B97F4A7C15) + power[size:])
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values; one entry per start."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        rest = width - size
        values = np.minimum(values[: len(values) - rest], values[rest:])
    return values


def within(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each word on belong to one document."""
    if len(words) < n:
        return np.zeros(0, bool)
    return words.doc[: len(words) - n + 1] == words.doc[n - 1 :]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and their offsets."""
    length = end - start
    return data[ranges(start, length)], np.concatenate([[0], np.cumsum(length)])


def code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points in each span of UTF-8 bytes."""
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return begun[end] - begun[start]
