"""Token ids of many texts from the ids of their distinct segments.

A tokenizer whose merges never cross a segment border gives the same ids for a text as
for its segments one after the other. A worker therefore keeps the ids of the segments
it has met, in a hash table made of NumPy arrays, and asks the tokenizer for new ones
only. Segments are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from varscope.llm.blocks import U, ranges, span_hash

# What a worker remembers before it starts anew, so that its memory is bounded.
REMEMBERED = 300_000
IDS_PER_SEGMENT = 6


class SegmentIds:
    """Ids of byte spans; ``encode`` gives the ids of each of a list of byte strings."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(1 << 20, -1, np.int32)
        self.size = self.used = 0
        self.keys = np.zeros((2, 1 << 16), U)
        self.begin = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Number of each segment, or -1."""
        found = np.full(len(key), -1, np.int64)
        mask = U(len(self.slots) - 1)
        slot = (key & mask).astype(np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            number = self.slots[slot[open_]]
            filled = number >= 0
            open_, number = open_[filled], number[filled]
            hit = (self.keys[0][number] == key[open_]) & (self.keys[1][number] == check[open_])
            found[open_[hit]] = number[hit]
            open_ = open_[~hit]
            slot[open_] = (slot[open_] + 1) & int(mask)
        return found

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.keys[0][numbers] & U(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            taken = self.slots[slot] != numbers
            numbers, slot = numbers[taken], (slot[taken] + 1) & mask

    def _learn(self, key: np.ndarray, check: np.ndarray, segments: list[bytes]) -> None:
        flat, counts = self.encode(segments)
        n, end = self.size, self.size + len(segments)
        while end > len(self.begin):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.keys[0, n:end], self.keys[1, n:end] = key, check
        self.begin[n:end] = self.used + np.cumsum(counts) - counts
        self.count[n:end] = counts
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.size = end
        if 2 * end > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            self._place(np.arange(end))
        else:
            self._place(np.arange(n, end))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after the other, number of ids of each span).

        ``data`` has eight spare bytes at either side of the spans.
        """
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.size > self.remembered or self.used > IDS_PER_SEGMENT * self.remembered:
            self.forget()
        key, check = span_hash(data, start, end), span_hash(data, start, end, 1)
        number = self.find(key, check)
        new = np.flatnonzero(number < 0)
        if len(new):
            order = new[np.lexsort((check[new], key[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
            sample = order[fresh]
            segments = [data[s:e].tobytes() for s, e in zip(start[sample].tolist(), end[sample].tolist())]
            self._learn(key[sample], check[sample], segments)
            number[new] = self.find(key[new], check[new])
        count = self.count[number].astype(np.int64)
        return self.ids[ranges(self.begin[number], count)], count


def flatten(encoded: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter((i for ids in encoded for i in ids), np.int32, int(counts.sum())), counts
