"""Packing of tokenised documents into sequences of a fixed length.

Method: bounded-space online packing. A task keeps at most ``OPEN_WINDOWS`` open windows.
The next piece of a document goes to the open window it fills best. Where none has room
for it, the fullest window takes as much of it as it holds, is full and leaves; the rest
of the piece is placed again. What a task still holds at its end is less than
``OPEN_WINDOWS`` windows of tokens; these leftovers are merged over all tasks into full
sequences, and the last few tokens into sequences whose lengths are powers of two. So no
sequence needs padding.

Scale: one pass over the text without a shuffle; full windows leave a task as they are
made. The result of that pass is stored, so that a lost executor cannot mix two runs of
a task. The leftovers are at most ``OPEN_WINDOWS * length`` tokens per task, whatever
the size of the input; their places come from sums over one row per task.

Defined results. A null or empty text is only the end id. Rows that share a ``doc_id``
are packed each on their own; ``doc_id`` may be null. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscope.llm.blocks import blocks, find_words, ranges, text_bytes
from varscope.llm.segments import SegmentIds, flatten
from varscope.llm.tasks import text_rows
from varscope.session import materialize

LENGTH = 4096
OPEN_WINDOWS = 16
END_ID = 2
# Segments a worker remembers; with fewer it asks the tokenizer for the same ones again.
REMEMBERED = 700_000
# A task's sequences are numbered from task * TASK_SEQUENCES; merged ones follow those of all tasks.
TASK_SEQUENCES = 1 << 36

PIECES = (
    "doc_id long, start long, doc_tokens long, ids binary, task long, sequence long, offset long, full boolean"
)

_LETTER = np.zeros(256, bool)
_LETTER[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[0x2C, 0x2E]] = True
_KEEP_CASE = np.zeros(256, bool)
_KEEP_CASE[0x80:] = True
_KEEP_CASE[0x3C] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# Texts that a tokenizer must give the ids of their segments, or it is not of the kind meant.
PROBES = (
    "The Quick  brown\tfox\njumps, over. THE lazy dog's 12,5 km.",
    "Ends with a comma, and\r\n\x0b\x0cstarts anew. x",
    "a b  c.d e,f g.. h,, (i) Don't stop",
)


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space and lowers case.

    Words, cut at ASCII white space, are its segments. A comma or full stop after a
    letter is a token of its own and is cut off too; words of ASCII characters are
    lowered first (unless they hold ``<``, which may open a special token). Both only
    make fewer distinct segments.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.segments = SegmentIds(self.encode, REMEMBERED)
        ids, _ = self(pa.array(PROBES))
        whole, _ = flatten([self.tokenizer.encode(text, add_special_tokens=False).ids for text in PROBES])
        if not np.array_equal(ids, whole):
            raise ValueError(f"{path}: the ids of a text are not those of its words; this tokenizer is not supported")

    def encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode("utf-8", "replace") for s in segments]
        return flatten([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        data, offsets = text_bytes(column)
        words = find_words(data, offsets)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        data, start, end, doc = words.data, words.start, words.end, words.doc
        cut = (end - start > 1) & _CLOSING[data[end - 1]] & _LETTER[data[end - 2]]
        lowered = _LOWER[data]
        marked = np.concatenate([[0], np.cumsum(_KEEP_CASE[data], dtype=np.int64)])
        as_is = np.flatnonzero(marked[end] > marked[start])
        at = ranges(start[as_is], end[as_is] - start[as_is])
        lowered[at] = data[at]
        word_end = end - cut
        place = np.cumsum(1 + cut) - (1 + cut)  # of each word among the segments
        total = int(len(start) + cut.sum())
        seg_start, seg_end = np.empty(total, np.int64), np.empty(total, np.int64)
        seg_start[place], seg_end[place] = start, word_end
        seg_start[place[cut] + 1], seg_end[place[cut] + 1] = word_end[cut], end[cut]
        ids, counts = self.segments(lowered, seg_start, seg_end)
        return ids, np.bincount(np.repeat(doc, 1 + cut), weights=counts, minlength=len(offsets) - 1).astype(np.int64)


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker and file, so that tasks go on with the segments met by earlier ones."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document."""
    closed = counts + 1
    out = np.full(int(closed.sum()), end_id, np.int32)
    before = np.cumsum(closed) - closed
    out[ranges(before, counts)] = ids
    return out, closed


class Packer:
    """Open windows of one task. A piece is (row, start in its document, length)."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []  # (tokens held, pieces)
        self.done: list[list] = []

    def add(self, piece: tuple[int, int, int]) -> None:
        row, start, size = piece
        while size:
            best = None
            for k, (held, _) in enumerate(self.open):
                if held + size <= self.length and (best is None or held > self.open[best][0]):
                    best = k
            if best is None and len(self.open) < self.windows:
                self.open.append((0, []))
                best = len(self.open) - 1
            if best is None:
                best = max(range(len(self.open)), key=lambda k: self.open[k][0])
            held, pieces = self.open[best]
            part = min(size, self.length - held)
            pieces.append((row, start, part))
            start, size = start + part, size - part
            if held + part == self.length:
                self.done.append(pieces)
                del self.open[best]
            else:
                self.open[best] = (held + part, pieces)

    def take_done(self) -> list[list]:
        done, self.done = self.done, []
        return done


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, length: int, windows: int, end_id: int, task: int):
    tokens, packer, sequence = word_tokens(path), Packer(length, windows), 0
    held: dict[int, tuple] = {}  # ids of pieces in open windows, by row
    row = 0

    def rows_of(groups: list[list], first: int, full: bool) -> pa.RecordBatch:
        doc, start, total, ids, seq, offset = [], [], [], [], [], []
        for k, pieces in enumerate(groups, first):
            place = 0
            for r, begin, size in pieces:
                doc_id, all_ids, origin = held[r]
                doc.append(doc_id)
                start.append(begin)
                total.append(origin[1])
                ids.append(all_ids[begin - origin[0] : begin - origin[0] + size].astype("<u4").tobytes())
                seq.append(k)
                offset.append(place)
                place += size
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(total, pa.int64()),
                pa.array(ids, pa.binary()), pa.array([task] * len(doc), pa.int64()), pa.array(seq, pa.int64()),
                pa.array(offset, pa.int64()), pa.array([full] * len(doc), pa.bool_()),
            ],
            ["doc_id", "start", "doc_tokens", "ids", "task", "sequence", "offset", "full"],
        )

    for block in blocks(batches, "text"):
        ids, counts = with_end(*tokens(block.column("text")), end_id)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for k, doc_id in enumerate(block.column("doc_id").to_pylist()):
            total = int(counts[k])
            held[row] = (doc_id, ids[edges[k] : edges[k + 1]], (0, total))
            for begin in range(0, total, length):
                packer.add((row, begin, min(length, total - begin)))
            row += 1
        done = packer.take_done()
        if done:
            yield rows_of(done, sequence, True)
            sequence += len(done)
        # of the block's ids only those in open windows stay
        left: dict[int, tuple] = {}
        for _, pieces in packer.open:
            for r, begin, size in pieces:
                doc_id, all_ids, (origin, total) = held[r]
                key = len(left) + row
                left[key] = (doc_id, all_ids[begin - origin : begin - origin + size].copy(), (begin, total), r)
        renamed, at = [], iter(left)
        for n, pieces in packer.open:
            renamed.append((n, [(next(at), begin, size) for _, begin, size in pieces]))
        packer.open = renamed
        row += len(left)
        held = {k: v[:3] for k, v in left.items()}
    if packer.open:
        yield rows_of([pieces for _, pieces in packer.open], sequence, False)


def first_pass(docs: DataFrame, path: str, length: int, windows: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_batches(batches, path, length, windows, end_id, TaskContext.get().partitionId())

    return docs.mapInArrow(run, PIECES)


def merge_leftovers(left: DataFrame, length: int) -> DataFrame:
    """Pieces of open windows, laid end to end over all tasks and cut into sequences."""
    size = F.length("ids") / 4
    left = left.withColumn("size", size.cast("long"))
    # one row per task: how many leftover tokens the earlier tasks have
    tasks = left.groupBy("task").agg(F.sum("size").alias("tokens"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(
        "task",
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"),
        F.sum("tokens").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    own = Window.partitionBy("task").orderBy("sequence", "offset").rowsBetween(Window.unboundedPreceding, -1)
    placed = left.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(tasks, "task")
    placed = placed.withColumn("begin", F.col("before") + F.col("within")).withColumn(
        "end", F.col("begin") + F.col("size")
    )
    # full sequences first; the tail's sequences have the powers of two of its length
    n_full = F.floor(F.col("all") / length)
    tail = F.col("all") - n_full * length
    borders = F.concat(
        F.expr(f"transform(sequence(floor(begin / {length}), floor((end - 1) / {length})), n -> n * {length})"),
        F.transform(
            F.expr(f"sequence(0, {length.bit_length() - 1})"),
            lambda bit: n_full * length + tail - F.pmod(tail, F.call_function("shiftleft", F.lit(2).cast("long"), bit)),
        ),
    )
    cuts = F.array_sort(
        F.array_distinct(
            F.filter(
                F.concat(F.array("begin"), borders), lambda x: (x >= F.col("begin")) & (x < F.col("end"))
            )
        )
    )
    placed = placed.withColumn("cuts", cuts)
    piece = placed.select("*", F.posexplode("cuts").alias("k", "from"))
    upto = F.coalesce(F.get("cuts", F.col("k") + 1), F.col("end"))
    piece = piece.withColumn("upto", upto)
    # the sequence's first token: below the tail a multiple of the length, in it the last border
    in_tail = F.col("from") >= n_full * length
    head = F.when(~in_tail, F.floor(F.col("from") / length) * length).otherwise(
        F.array_max(F.filter(F.col("tail_borders"), lambda x: x <= F.col("from")))
    )
    piece = piece.withColumn(
        "tail_borders",
        F.transform(
            F.expr(f"sequence(0, {length.bit_length() - 1})"),
            lambda bit: n_full * length + tail - F.pmod(tail, F.call_function("shiftleft", F.lit(2).cast("long"), bit)),
        ),
    )
    piece = piece.withColumn("tail_borders", F.concat("tail_borders", F.array(n_full * length)))
    piece = piece.withColumn("head", head)
    skip = F.col("from") - F.col("begin")
    return piece.select(
        "doc_id",
        (F.col("start") + skip).alias("start"),
        "doc_tokens",
        F.substring("ids", (skip * 4 + 1).cast("int"), ((F.col("upto") - F.col("from")) * 4).cast("int")).alias("ids"),
        (F.lit(-1) - F.col("head")).alias("sequence_id"),
        (F.col("from") - F.col("head")).alias("offset"),
    )


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, doc_tokens, ids, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers.
    ``path`` names the tokenizer's file; it must exist on every executor. Merged
    sequences have negative numbers.
    """
    pieces = materialize(first_pass(text_rows(docs, doc_id, text), path, length, windows, end_id))
    whole = pieces.filter("full").select(
        "doc_id", "start", "doc_tokens", "ids",
        (F.col("task") * TASK_SEQUENCES + F.col("sequence")).alias("sequence_id"),
        "offset",
    )
    return whole.unionByName(merge_leftovers(pieces.filter("not full"), length))
