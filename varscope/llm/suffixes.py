"""Suffix-array dedup: repeated passages of at least ``LENGTH`` words, found by sparse suffixes.

Method. A suffix of a text is retained where the text itself selects it: every stretch of
``LENGTH`` words names the place of the smallest hash among its first ``REACH`` grams of
``GRAM`` words. Equal stretches name equal places, so two copies of a passage retain
suffixes that agree on ``PREFIX`` words at least. A first sort, of hashes of that prefix,
finds the suffixes that have a neighbour with an equal one; only these are read on. They
are then sorted by their words, up to the end of the stretches that name them, and each is
compared with its neighbour: the number of words they share. The same is done with the
words before them, read backwards. A stretch that begins ``a`` words before a suffix
repeats where a stretch of neighbours shares ``a`` words to the left and the rest of the
``LENGTH`` words to the right.

Scale. About two of 27 positions are retained, and the sort moves only a hash for each.
Text travels for the agreeing suffixes alone, in answer to the sort, and a string held
by many documents travels once per group of documents. Groups hold ``tasks.GROUP_BYTES``
of text. A prefix whose strings outgrow a group over all documents is hot: words to the
left of a frequent phrase differ between documents, so folding does not bound it. The
first sort tells the groups, and the stretches of hot prefixes travel one by one to the
bucket of their own 50 words. Rows repeated so often that they outgrow a group are folded
to one row and given back at the end.

Defined results. A stretch is a repeat in a document if a document with a smaller id has
it. A null or empty text has none; a document without ``doc_id`` neither has repeats nor
gives any. Rows that share a ``doc_id`` are one document for the comparison. Repeats
within one document do not count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varscope.llm.blocks import U, Words, find_words, gather, mix, ngrams, ranges, span_hash, span_ids, text_bytes, within
from varscope.llm.tasks import GROUP_BYTES, folded, group_count, group_of, text_rows, unfolded
from varscope.llm.windows import among, covered, pack, unpack

LENGTH = 50
GRAM = 8
REACH = 26
PREFIX = LENGTH - REACH + 1
# A run of stretches is cut here; see ``windows.RUN_WINDOWS``.
RUN_STRETCHES = 64

# Strings are weighed in units, so that nearly all weights are one and compress to nothing.
UNIT = 1024

SPANS = "doc_id long, start_word long, n_words long, first_doc_id long, copies long"


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    place, size = np.arange(len(values)), 1

    def lower(left, right):
        return np.where(values[right] < values[left], right, left)

    while 2 * size <= width:
        place = lower(place[:-size], place[size:])
        size *= 2
    if size < width:
        rest = width - size
        place = lower(place[: len(place) - rest], place[rest:])
    return place


class Suffixes:
    """The retained suffixes of one group of documents.

    ``start`` and ``length`` are the stretches that name a suffix, one run per suffix.
    Runs with equal strings share a ``number``.
    """

    def __init__(self, docs: pa.Table):
        data, offsets = text_bytes(docs.column("text"))
        ids = docs.column("doc_id")
        has_id, self.doc_ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0), np.int64)
        self.words = words = find_words(data, offsets)
        h = span_hash(words.data, words.start, words.end)
        valid = within(words, LENGTH)
        valid &= has_id[words.doc[: len(valid)]]
        place = sliding_argmin(ngrams(h, GRAM), REACH)[: len(valid)]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        position = np.arange(len(valid))
        begun = np.maximum.accumulate(np.where(new, position, 0)) if len(valid) else position
        new |= valid & ((position - begun) % RUN_STRETCHES == 0)
        self.start = np.flatnonzero(new)
        self.length = np.bincount((np.cumsum(new) - 1)[valid], minlength=len(self.start))
        self.valid, self.place, self.prefix_at = valid, place, ngrams(h, PREFIX)
        self.prefix = self.prefix_at[place[self.start]]
        self.doc = self.doc_of(self.start)
        self.content = content = ngrams(h, LENGTH)
        at = ranges(self.start, self.length)
        offset = (at - np.repeat(self.start, self.length)).astype(U)
        starts = np.cumsum(self.length) - self.length
        keys = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            terms = mix(content[at] + offset * U(seed))
            keys.append(np.add.reduceat(terms, starts) if len(starts) else terms)
        self.anchor = place[self.start] - self.start  # words of the first stretch before the suffix
        # equal strings name their suffix at the same place; rows come by document, so ties need no key
        keys[0] = mix(keys[0] + self.anchor.astype(U))
        order = np.lexsort((keys[1], keys[0], self.prefix))
        change = np.ones(len(order), bool)
        for key in (self.prefix, *keys):
            change[1:] &= key[order][1:] == key[order][:-1]
        change[1:] = ~change[1:]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(change) - 1
        heads = np.flatnonzero(change)
        last = np.append(heads[1:], len(order)) - 1 if len(order) else heads
        self.run = order[heads]  # of each distinct string: the run in its smallest document
        self.shared = self.doc[order[last]] != self.doc[self.run]
        # of each distinct prefix: its strings; numbers follow the order of prefixes
        self.prefixes, first = np.unique(self.prefix[self.run], return_index=True)
        self.prefix_of = np.searchsorted(self.prefixes, self.prefix[self.run])
        self.alone = np.bincount(self.prefix_of, weights=1 + self.shared, minlength=len(first)) == 1
        begin, end = self.edges(self.start[self.run], self.length[self.run])
        weight = 1 + (end - begin) // UNIT
        self.weight = np.bincount(self.prefix_of, weights=weight, minlength=len(first)).astype(np.int32)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.doc_ids[self.words.doc[at]]

    def edges(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of the strings of so many stretches, and the byte after the last."""
        return self.words.start[start], self.words.end[start + length + LENGTH - 2]

    def stretches(self, prefixes: np.ndarray) -> np.ndarray:
        """All stretches that name a suffix with one of the prefixes, which are sorted."""
        at = np.flatnonzero(self.valid)
        return at[among(self.prefix_at[self.place[at]], prefixes)]

    def packed(self, number, start, length, shared, single: bool) -> bytes:
        text, offsets = gather(self.words.data, *self.edges(start, length))
        return pack(
            number=number.astype(np.int32), doc=self.doc_of(start), shared=shared,
            size=np.diff(offsets).astype(np.int32), anchor=(self.place[start] - start).astype(np.int8),
            single=np.array([single]), text=text,
        )


def ordered(docs: pa.Table) -> pa.Table:
    """The rows of a group in an order that does not depend on their arrival."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(edges, np.append(edges[1:], len(order))):
        yield int(bucket[order[lo]]), order[lo:hi]


def table_of(rows: list[tuple], first: str, second: str, third: str | None = None) -> pa.Table:
    names = [n for n in (first, second, third) if n]
    columns = list(zip(*rows)) or [[] for _ in names]
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def neighbours(table: pa.Table, hot_bytes: int) -> pa.Table:
    """Sorts the prefixes of a bucket; tells each group which have an equal neighbour, and which are hot."""
    cells = np.asarray(table.column("cell"), np.int64)
    order = np.argsort(cells, kind="stable")
    parts = [unpack(table.column("prefixes")[int(i)].as_py(), place=np.int32, prefix=U, alone=bool, weight=np.int32) for i in order]
    prefix = np.concatenate([p[1] for p in parts])
    alone = np.concatenate([p[2] for p in parts])
    by_prefix = np.argsort(prefix, kind="stable")
    equal = prefix[by_prefix][1:] == prefix[by_prefix][:-1]
    agrees = ~alone
    agrees[by_prefix[1:][equal]] = True
    agrees[by_prefix[:-1][equal]] = True
    number = np.empty(len(prefix), np.int64)
    number[by_prefix] = np.cumsum(np.concatenate([[True], ~equal])[: len(prefix)]) - 1
    hot = (np.bincount(number, weights=np.concatenate([p[3] for p in parts])) * UNIT > hot_bytes)[number]
    rows, before = [], 0
    for i, (place, *_) in zip(order, parts):
        mine = np.flatnonzero(agrees[before : before + len(place)])
        if len(mine):
            rows.append((int(cells[i]), pack(place=place[mine], hot=hot[before + mine])))
        before += len(place)
    return table_of(rows, "cell", "agreeing")


def sorted_neighbours(word: np.ndarray, at: np.ndarray, size: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the sequences by their words, words that each shares with the one before it).

    A sequence is ``word[at], word[at + step], ...`` of ``size`` words. All are sorted at
    once: ranks of one word more follow from the ranks so far and the next words.
    """
    rank, shared = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    bound = int(word.max(initial=0)) + 2
    columns = []
    for k in range(int(size.max(initial=0))):
        has = size > k
        following = np.zeros(len(at), np.int64)  # a sequence that ends comes first
        following[has] = word[at[has] + step * k] + 1
        _, rank = np.unique(rank * bound + following, return_inverse=True)
        columns.append((rank, has))
    order = np.argsort(rank, kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for rank, has in columns:
        same &= (rank[order[1:]] == rank[order[:-1]]) & has[order[1:]]
        shared[1:] += same
    return order, shared


def intervals(order: np.ndarray, shared: np.ndarray, words: int) -> np.ndarray:
    """For each sequence, the number of the run of neighbours that share so many words."""
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(shared < words) if words else 0
    return number


def earliest(words: Words, doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches of each string, smallest document that has each stretch), string by string."""
    ids, _ = span_ids(words.data, words.start, words.end)
    stretches = words.counts() - LENGTH + 1
    begins = np.cumsum(stretches) - stretches
    at = words.first[:-1] + anchor
    right = sorted_neighbours(ids, at, words.first[1:] - at, 1)
    left = sorted_neighbours(ids, at - 1, anchor, -1)
    least = np.empty(int(stretches.sum()), np.int64)
    for before in range(REACH):  # stretches that begin so many words before their suffix
        place = anchor - before
        some = np.flatnonzero((place >= 0) & (place < stretches))
        if not len(some):
            continue
        key = intervals(*right, LENGTH - before)[some] * len(at) + intervals(*left, before)[some]
        _, group = np.unique(key, return_inverse=True)
        smallest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, doc[some])
        least[begins[some] + place[some]] = smallest[group]
    return stretches, least


def extended(table: pa.Table) -> pa.Table:
    """Sorts the suffixes of a bucket, extends the matches of neighbours to both sides, and
    answers the smallest document of each stretch."""
    cells = np.asarray(table.column("cell"), np.int64)
    order = np.argsort(cells, kind="stable")
    parts = [
        unpack(
            table.column("strings")[int(i)].as_py(),
            number=np.int32, doc=np.int64, shared=bool, size=np.int32, anchor=np.int8, single=bool, text=np.uint8,
        )
        for i in order
    ]
    sizes = np.concatenate([p[3] for p in parts]).astype(np.int64)
    words = find_words(np.concatenate([p[6] for p in parts]), np.concatenate([[0], np.cumsum(sizes)]))
    doc = np.concatenate([p[1] for p in parts])
    stretches, least = earliest(words, doc, np.concatenate([p[4] for p in parts]).astype(np.int64))
    starts = np.cumsum(stretches) - stretches
    wanted = (np.minimum.reduceat(least, starts) < doc) | np.concatenate([p[2] for p in parts])
    rows, before = [], 0
    for i, part in zip(order, parts):
        mine = before + np.flatnonzero(wanted[before : before + len(part[1])])
        if len(mine):
            n = stretches[mine]
            rows.append(
                (
                    int(cells[i]),
                    pack(
                        number=part[0][mine - before], stretches=n.astype(np.int32),
                        least=least[ranges(starts[mine], n)], single=part[5],
                    ),
                )
            )
        before += len(part[1])
    return table_of(rows, "cell", "answers")


def spans(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Maximal repeated spans of a group's documents, with the smallest document of their stretches."""
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("doc_id", "start_word", "n_words", "first_doc_id", "copies")})
    if not docs.num_rows or not answers.num_rows:
        return empty
    docs = ordered(docs)
    parts = [
        unpack(x.as_py(), number=np.int32, stretches=np.int32, least=np.int64, single=bool)
        for x in answers.column("answers")
    ]
    own = Suffixes(docs)
    found = []
    for single in (False, True):
        mine = [p[:3] for p in parts if p[3][0] == single]
        if not mine:
            continue
        number, stretches, least = (np.concatenate(x) for x in zip(*mine))
        if single:  # stretches by themselves: those of equal words have the same answer
            order = np.argsort(own.content[number], kind="stable")
            number, least = number[order], least[order]
            at = own.stretches(np.unique(own.prefix_at[own.place[number]]))
            place = np.minimum(np.searchsorted(own.content[number], own.content[at]), len(number) - 1)
            answered = own.content[number][place] == own.content[at]
            at, owner = at[answered], least[place[answered]]
            earlier = owner < own.doc_of(at)
        else:
            place = np.full(len(own.run), -1)
            place[number] = np.arange(len(number))
            begins = np.cumsum(stretches) - stretches
            runs = np.flatnonzero(place[own.number] >= 0)
            length = own.length[runs]
            at = ranges(own.start[runs], length)
            owner = least[ranges(begins[place[own.number[runs]]], length)]
            earlier = owner < np.repeat(own.doc[runs], length)
        found.append((at[earlier], owner[earlier]))
    at, owner = (np.concatenate(x) for x in zip(*found))
    if not len(at):
        return empty
    words = own.words
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    inside = covered(len(words), at, LENGTH)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (words.doc[1:] != words.doc[:-1])
    start = np.flatnonzero(starts)
    size = np.bincount((np.cumsum(starts) - 1)[inside], minlength=len(start))
    span_of = np.searchsorted(start, at, "right") - 1
    first = np.minimum.reduceat(owner, np.searchsorted(span_of, np.arange(len(start))))
    doc = words.doc[start]
    return pa.table(
        {
            "doc_id": docs.column("doc_id").take(pa.array(doc)),
            "start_word": pa.array(start - words.first[doc], pa.int64()),
            "n_words": pa.array(size, pa.int64()),
            "first_doc_id": pa.array(first, pa.int64()),
            "copies": docs.column("copies").take(pa.array(doc)),
        }
    )


def agreeing_strings(
    table: pa.Table, agreeing: pa.Table, bucket_of: Callable[[np.ndarray], np.ndarray]
) -> Iterator[tuple[int, bytes]]:
    """The strings of a group's agreeing prefixes: of hot ones, each stretch by its own words."""
    docs = ordered(table)
    own = Suffixes(docs)
    agrees, hot = np.zeros(len(own.prefixes), bool), np.zeros(len(own.prefixes), bool)
    for answer in agreeing.column("agreeing"):
        place, is_hot = unpack(answer.as_py(), place=np.int32, hot=bool)
        agrees[place] = True
        hot[place] = is_hot
    number = np.flatnonzero((agrees & ~hot)[own.prefix_of])
    for bucket, at in by_bucket(bucket_of(own.prefixes[own.prefix_of[number]])):
        mine = number[at]
        run = own.run[mine]
        yield bucket, own.packed(mine, own.start[run], own.length[run], own.shared[mine], False)
    if hot.any():
        at = own.stretches(own.prefixes[hot])
        order = at[np.argsort(own.content[at], kind="stable")]  # of equal ones, the smallest document comes first
        heads = np.flatnonzero(np.diff(own.content[order], prepend=~own.content[order[:1]]))
        lasts = np.append(heads[1:], len(order)) - 1
        start, shared = order[heads], own.doc_of(order[heads]) != own.doc_of(order[lasts])
        for bucket, some in by_bucket(bucket_of(own.content[start])):
            yield bucket, own.packed(start[some], start[some], np.ones(len(some), np.int64), shared[some], True)


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``doc_id, start_word, n_words, first_doc_id``: one row per maximal span of repeated stretches.

    Every word of a span lies in a stretch of LENGTH words that a document with a smaller
    id has as well; ``first_doc_id`` is the smallest of those documents. Documents
    without repeats have no row.
    """
    rows = folded(text_rows(docs, doc_id, text), group_bytes)
    groups = group_count(rows, "text", group_bytes)
    by_cell = rows.withColumn("cell", group_of(groups, "doc_id", "text")).groupBy("cell")

    def bucket_of(prefixes: np.ndarray) -> np.ndarray:
        return (mix(prefixes) % U(groups)).astype(np.int64)

    def retain(key: tuple, table: pa.Table) -> pa.Table:
        own = Suffixes(ordered(table))
        found = []
        for bucket, at in by_bucket(bucket_of(own.prefixes)):
            packed = pack(
                place=at.astype(np.int32), prefix=own.prefixes[at], alone=own.alone[at], weight=own.weight[at]
            )
            found.append((bucket, key[0].as_py(), packed))
        return table_of(found, "bucket", "cell", "prefixes")

    def extend(key: tuple, table: pa.Table, agreeing: pa.Table) -> pa.Table:
        if not table.num_rows or not agreeing.num_rows:
            return table_of([], "bucket", "cell", "strings")
        found = [(bucket, key[0].as_py(), packed) for bucket, packed in agreeing_strings(table, agreeing, bucket_of)]
        return table_of(found, "bucket", "cell", "strings")

    prefixes = by_cell.applyInArrow(retain, "bucket int, cell int, prefixes binary")
    agreeing = prefixes.groupBy("bucket").applyInArrow(lambda t: neighbours(t, group_bytes), "cell int, agreeing binary")
    strings = by_cell.cogroup(agreeing.groupBy("cell")).applyInArrow(extend, "bucket int, cell int, strings binary")
    answers = strings.groupBy("bucket").applyInArrow(extended, "cell int, answers binary")
    return unfolded(by_cell.cogroup(answers.groupBy("cell")).applyInArrow(spans, SPANS))
