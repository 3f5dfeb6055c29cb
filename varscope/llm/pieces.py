"""SentencePiece encoding with byte spans of the original text, and decoding.

Method: offset-preserving encoding. The text is normalised here, by longest-prefix
lookups in the model's compiled character map, and every normalised byte keeps the
source position it comes from. The library then encodes the normalised text with its own
normaliser switched off, and each piece is projected to the bytes of the original text.

Within a worker the ids of normalised segments (white space and the word after it) are
remembered, see ``segments``; this is used only for models in which no piece can cross a
segment border.

Defined results. A null text counts as empty; an empty text has only the begin and end
ids. A byte piece that is not the last of its character has an empty span. Spans of the
begin and end ids are empty, at either end of the text. Other columns pass through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from varscope.llm.blocks import blocks, ranges, text_bytes, to_strings
from varscope.llm.segments import SegmentIds, flatten

MARK = "▁".encode()
# Text that one vectorised step encodes; it needs some seventy times as much memory.
STEP_BYTES = 1 << 18
DECODE_ROWS = 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
ENCODED = "struct<ids: binary, begins: binary, ends: binary>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest prefix of ``text[at:]`` in the map."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        begin = found[1]
        return found[0], self.texts[begin : self.texts.index(0, begin)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class Normaliser:
    """Normalised bytes of texts, with the source position of each of them."""

    def __init__(self, spec: bytes):
        fields = dict(message_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.prefix = bool(fields.get(3, 1))
        self.squeeze = bool(fields.get(4, 1))
        self.space = MARK if fields.get(5, 1) else b" "

    def one(self, text: bytes) -> tuple[bytes, list[int]]:
        """Any model: character by character. The positions have one entry more than the bytes."""
        out, source, at = bytearray(), [], 0
        steps = []
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                first = text[at]
                size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = size, text[at : at + size]
            steps.append((at, found[1]))
            at += found[0]
        first = 0
        while self.squeeze and first < len(steps) and steps[first][1] == b" ":
            first += 1
        if first == len(steps):
            return b"", [at if self.squeeze else 0]
        if self.prefix:
            out += self.space
            source += [steps[first][0]] * len(self.space)
        after_space = self.squeeze
        for begin, piece in steps[first:]:
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                written = piece.replace(b" ", self.space)
                out += written
                source += [begin] * len(written)
                after_space = piece.endswith(b" ") and self.squeeze
        source.append(len(text))
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :]
            del source[len(out) + 1 :]
        return bytes(out), source

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, their offsets, source positions with one entry more per text)."""
        n = len(offsets) - 1
        if self.map.units or self.squeeze:
            raw = data.tobytes()
            parts = [self.one(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            sizes = np.array([len(p[0]) for p in parts], np.int64)
            norm = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
            source = np.fromiter((x for p in parts for x in p[1]), np.int32, int(sizes.sum()) + n)
            return norm, np.concatenate([[0], np.cumsum(sizes)]), source
        # without a map: each space becomes the mark, and the mark stands before each text
        mark = np.frombuffer(self.space, np.uint8)
        width = np.where(data == 0x20, len(mark), 1)
        ends = np.concatenate([[0], np.cumsum(width)])
        filled = offsets[1:] > offsets[:-1]
        ahead = np.where(filled & self.prefix, len(mark), 0)
        sizes = ends[offsets[1:]] - ends[offsets[:-1]] + ahead
        norm_offsets = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(norm_offsets[:-1] + ahead - ends[offsets[:-1]], np.diff(offsets))
        at = ends[:-1] + shift
        norm = np.empty(int(norm_offsets[-1]), np.uint8)
        norm[at] = data
        spaces = at[data == 0x20]
        begins = norm_offsets[:-1][ahead > 0]
        for k, byte in enumerate(mark):
            norm[spaces + k] = byte
            norm[begins + k] = byte
        # bytes inside a character take the position of its first byte
        position = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        inside = (data & 0xC0) == 0x80
        position = np.maximum.accumulate(np.where(inside, -1, np.arange(len(data)))) - (
            np.arange(len(data)) - position
        ) if len(data) else position
        source = np.zeros(len(norm) + n, np.int32)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        target = at + doc
        source[target] = position
        for k in range(1, len(mark)):
            source[target[data == 0x20] + k] = position[data == 0x20]
        source[norm_offsets[1:] + np.arange(n)] = np.diff(offsets)
        return norm, norm_offsets, source


class Pieces:
    """One model's encoder."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        spec = b"".join(v for k, v in message_fields(model) if k == 3)
        pieces = [dict(message_fields(v)) for k, v in message_fields(model) if k == 1]
        self.normaliser = Normaliser(spec)
        # the same model with an identity normaliser: no map, no prefix, no squeezing, no marks
        off = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(off)]) + off)
        self.begin_id, self.end_id = self.encoder.bos_id(), self.encoder.eos_id()
        kind = np.array([p.get(3, NORMAL) for p in pieces])
        self.width = np.array([1 if k == BYTE else len(p.get(1, b"")) for k, p in zip(kind, pieces)], np.int32)
        self.width[kind == CONTROL] = 0
        self.unknown = int(np.flatnonzero(kind == UNKNOWN)[0])
        texts = [p[1].decode() for k, p in zip(kind, pieces) if k not in (CONTROL, UNKNOWN, BYTE)]
        mark = MARK.decode()
        crossing = any(mark in t.lstrip(mark) for t in texts) or (kind == USER).any() or self.normaliser.space != MARK
        joined = {c for t in texts if len(t) > 1 for c in t}
        self.alone = np.zeros(256, bool)  # ASCII bytes that no merge takes in
        self.alone[[b for b in range(128) if chr(b) not in joined]] = True
        self.whole_texts = bool(crossing)
        self.segments = SegmentIds(self._encode)

    def _encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode("utf-8", "replace") for s in segments]
        ids, counts = flatten(self.encoder.encode(texts, num_threads=1))
        if (ids == self.unknown).any():
            raise ValueError("spans need a model with byte fallback: a character has no piece")
        return ids, counts

    def cut(self, norm: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the segments."""
        starts = np.zeros(len(norm), bool)
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if not self.whole_texts and len(norm) > 2:
            marks = np.zeros(len(norm), bool)
            marks[:-2] = (norm[:-2] == MARK[0]) & (norm[1:-1] == MARK[1]) & (norm[2:] == MARK[2])
            fresh = marks.copy()
            fresh[3:] &= ~marks[:-3]
            alone = self.alone[norm]
            starts |= fresh | alone
            starts[1:] |= alone[:-1]
        return np.flatnonzero(starts)

    def encode(self, column: pa.Array, ends: bool = True) -> pa.StructArray:
        """Ids and byte spans of whole texts; with the begin and end ids if ``ends``."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        norm, norm_offsets, source = self.normaliser(data, offsets)
        start = self.cut(norm, norm_offsets)
        padded = np.zeros(len(norm) + 16, np.uint8)
        padded[8 : 8 + len(norm)] = norm
        ids, per_segment = self.segments(padded, start + 8, np.append(start[1:], len(norm)) + 8 if len(start) else start)
        doc = np.searchsorted(norm_offsets, start, "right") - 1
        counts = np.bincount(doc, weights=per_segment, minlength=n).astype(np.int64)
        after = np.cumsum(self.width[ids], dtype=np.int64)
        if len(ids) and after[-1] != len(norm):
            raise ValueError("the pieces do not cover the normalised text")
        piece_doc = np.repeat(np.arange(n), counts)
        upto = source[after + piece_doc]  # past the last piece of a text lies its closing entry
        since = source[after - self.width[ids] + piece_doc]
        if not ends:
            return self._rows(counts, ids, since, upto)
        size = counts + 2
        at = ranges(np.cumsum(size) - size + 1, counts)
        out = np.zeros((3, int(size.sum())), np.int32)
        first, last = np.cumsum(size) - size, np.cumsum(size) - 1
        out[0, first], out[0, last] = self.begin_id, self.end_id
        out[1, last] = out[2, last] = np.diff(offsets)
        out[0, at], out[1, at], out[2, at] = ids, since, upto
        return self._rows(size, *out)

    @staticmethod
    def _rows(counts, *columns) -> pa.StructArray:
        edges = np.concatenate([[0], np.cumsum(counts * 4)])
        packed = [
            to_strings(np.ascontiguousarray(c, "<i4").view(np.uint8), edges, pa.binary()) for c in columns
        ]
        return pa.StructArray.from_arrays(packed, ["ids", "begins", "ends"])


_models: dict[str, Pieces] = {}
_decoders: dict = {}


def model(path: str) -> Pieces:
    """One per worker and file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(text: Column, path: str) -> Column:
    """Struct of ``ids``, ``begins``, ``ends``: little-endian 32-bit integers, one per piece.

    The spans count bytes of the text in UTF-8. ``path`` names the model's file; it must
    exist on every executor.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = model(path)
        for column in columns:
            rows = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [pieces.encode(block.column(0)) for block in blocks(iter([rows]), "text", STEP_BYTES)]
            yield pa.concat_arrays(parts) if parts else pieces.encode(column)

    return F.arrow_udf(run, ENCODED)(text.cast("string"))


def decode(ids: Column, path: str) -> Column:
    """Text of packed ids, as the library decodes the whole list; null ids give an empty text."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        if path not in _decoders:
            _decoders[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        for column in columns:
            texts: list[str] = []
            for part in (column.slice(k, DECODE_ROWS) for k in range(0, len(column), DECODE_ROWS)):
                lists = [np.frombuffer(x.as_buffer(), "<i4").tolist() if x.is_valid else [] for x in part]
                texts.extend(_decoders[path].decode(lists, num_threads=1))
            yield pa.array(texts, pa.string())

    return F.arrow_udf(run, "string")(ids)
