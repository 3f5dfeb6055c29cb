"""Spelling variants: words one edit apart, and the frequent form each rare one stands for.

Method: finite-state composition. The vocabulary is a minimised acyclic acceptor A, one
edit is a transducer E (copy any letter; once insert, drop or replace one), and the pairs
that A o E o A accepts are the near words. A state of the composition is a state of either
acceptor and whether the edit is used. Before the edit both words have read the same
letters, so the two states are one and the same; after it both sides read equal letters
until both accept. The edit is put at the first place where the words differ, so each pair
is found once. Words are numbered by the offsets on the arcs, as in a perfect hash.

Scale: the composition is cut by initial states. A state is the set of words that share a
prefix. One with more than ``limit`` words is not opened in a task: its pairs whose edit
follows the prefix directly are groups of words that are equal but for the letter there
(at most one word for each letter and one without), found by an equi-join key, and its
other pairs belong to the states one letter further. So no task holds more than some
``limit`` words however many share a prefix. Tasks report per word the number of its near
words and the best one; pairs never leave a task. Occurrences are counted map-side.

Defined results. A null or empty text has no words. Rows without ``doc_id`` count with an
empty id; repeated rows count again. Ties of the most frequent near word go to the
smallest in code-point order. Other columns of the input are ignored. Of an empty table
the result is empty. Words of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscope.llm.blocks import U, mix, ranges
from varscope.llm.resample import LOWER, UPPER
from varscope.llm.tasks import text_rows
from varscope.operators.joins import join_per_key
from varscope.session import materialize

# Letters of a word once A-Z are lower case, and the least of a word.
LETTERS = "[a-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
# How many times more frequent a form must be than its variant.
TIMES = 10

# Words of one initial state that a task opens, and rows of one step of the composition.
LIMIT = 10_000
STEP_ROWS = 500_000

NEAR = "word string, n_near long, best_n long, best string"
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """``word, n``. With ``drop_every``, a run whose checksum with its id it divides loses a letter."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # maximal runs that are long enough: a match begins where its run does
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{min_length},}}+"), F.lit(0))).alias("word"))
    if drop_every:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
        runs = runs.withColumn("h", F.crc32(name)).withColumn("at", F.pmod("h", F.char_length("word")).cast("int"))
        cut = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.char_length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("word")))
        runs = runs.where(F.char_length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------------- the acceptor


class Acceptor:
    """Minimised acceptor of words in ascending order; words of one group share an initial state.

    Arcs are sorted by state and letter. ``offset`` of an arc is how many words its state
    accepts before those that pass the arc.
    """

    def __init__(self, group: np.ndarray, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, letters = np.unique(codes, return_inverse=True)
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        self._spread(group, letters, begin, length)
        self._merge()

    def _spread(self, group, letters, begin, length) -> None:
        """The trie: nodes numbered by depth, with the first word below each."""
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
        first, final, arcs = [starts], [], []
        active, depth, n = np.arange(len(length)), 0, len(starts)
        while len(active):
            ends = length[active] == depth
            final.append(node[active[ends]])
            active = active[~ends]
            letter, at = letters[begin[active] + depth], node[active]
            new = np.ones(len(active), bool)
            new[1:] = (at[1:] != at[:-1]) | (letter[1:] != letter[:-1])
            node[active] = n + np.cumsum(new) - 1
            arcs.append((at[new], letter[new], n + np.arange(int(new.sum()))))
            first.append(active[new])
            n += int(new.sum())
            depth += 1
        self.levels, self.first = arcs, np.concatenate(first)
        self.node_final = np.zeros(n, bool)
        self.node_final[np.concatenate(final)] = True

    def _merge(self) -> None:
        """States: nodes that accept the same words, told apart by 128 bits of hash."""
        hashes = [mix(self.node_final.astype(U) + U(seed)) for seed in (3, 5)]
        for source, letter, target in reversed(self.levels):
            if len(source):
                heads = np.flatnonzero(np.diff(source, prepend=-1))
                for h, seed in zip(hashes, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    term = mix(h[target] + (letter.astype(U) + U(1)) * U(seed))
                    h[source[heads]] = mix(h[source[heads]] + np.add.reduceat(term, heads))
        order = np.lexsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = (hashes[0][order][1:] != hashes[0][order][:-1]) | (hashes[1][order][1:] != hashes[1][order][:-1])
        state = np.empty(len(order), np.int64)
        state[order] = np.cumsum(new) - 1
        kept = np.zeros(len(order), bool)
        kept[order[new]] = True
        source, letter, target = (np.concatenate([x[k] for x in self.levels]) for k in range(3))
        mine = kept[source]
        source, letter, target = source[mine], letter[mine], target[mine]
        offset = self.first[target] - self.first[source]
        by = np.lexsort((letter, state[source]))
        self.state = state
        self.source, self.letter, self.target, self.offset = state[source][by], letter[by], state[target][by], offset[by]
        self.n_states = int(new.sum())
        self.final = np.zeros(self.n_states, bool)
        self.final[state] = self.node_final
        self.degree = np.bincount(self.source, minlength=self.n_states)
        self.begin = np.cumsum(self.degree) - self.degree
        self.key = self.source * len(self.alphabet) + self.letter

    def edits(self, states: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (state, offset, offset): words that differ first right after the state, by one edit."""
        degree, begin = self.degree[states], self.begin[states]
        # a letter replaced: two arcs of the state
        arcs = ranges(begin, degree)
        later = np.repeat(begin + degree, degree) - arcs - 1
        one, other = np.repeat(arcs, later), ranges(arcs + 1, later)
        # a letter dropped: an arc, and the state itself
        q = np.concatenate([self.source[one], self.source[arcs]])
        a = np.concatenate([self.target[one], self.target[arcs]])
        b = np.concatenate([self.target[other], self.source[arcs]])
        x = np.concatenate([self.offset[one], self.offset[arcs]])
        y = np.concatenate([self.offset[other], np.zeros(len(arcs), np.int64)])
        barred = np.concatenate([np.full(len(one), -1), self.letter[arcs]])  # the words would differ later only
        while len(q):
            both = self.final[a] & self.final[b]
            yield np.stack([q[both], x[both], y[both]])
            row = np.repeat(np.arange(len(q)), self.degree[a])
            arc = ranges(self.begin[a], self.degree[a])
            wanted = b[row] * len(self.alphabet) + self.letter[arc]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            met = (self.key[place] == wanted) & (self.letter[arc] != barred[row])
            row, arc, place = row[met], arc[met], place[met]
            q, x, y = q[row], x[row] + self.offset[arc], y[row] + self.offset[place]
            a, b, barred = self.target[arc], self.target[place], np.full(len(row), -1)

    def pairs(self, step_rows: int = STEP_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word numbers of near words, each pair once."""
        cost = np.cumsum(self.degree * (self.degree + 1) // 2)
        nodes = np.argsort(self.state, kind="stable")
        n_paths = np.bincount(self.state, minlength=self.n_states)
        before = np.cumsum(n_paths) - n_paths
        at = 0
        while at < self.n_states:
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + step_rows, "right")))
            for q, x, y in self.edits(np.arange(at, end)):
                paths = n_paths[q]
                whole = np.concatenate([[0], np.cumsum(paths)])
                lo = 0
                while lo < len(q):  # a state lies on many paths: each gives its own words
                    hi = max(lo + 1, int(np.searchsorted(whole, whole[lo] + step_rows, "right")) - 1)
                    base = self.first[nodes[ranges(before[q[lo:hi]], paths[lo:hi])]]
                    yield base + np.repeat(x[lo:hi], paths[lo:hi]), base + np.repeat(y[lo:hi], paths[lo:hi])
                    lo = hi
            at = end


def near_words(table: pa.Table) -> pa.Table:
    """Per word of (state, rest, n) rows: how many near words share its state, and the best."""
    table = table.sort_by([("state", "ascending"), ("rest", "ascending")]).combine_chunks()
    states, rests = table.column("state").to_pylist(), table.column("rest").to_pylist()
    n = np.asarray(table.column("n"), np.int64)
    group = np.cumsum([k > 0 and states[k] != states[k - 1] for k in range(len(states))])
    by = np.lexsort((np.arange(len(n)), -n))
    place = np.empty(len(n), np.int64)
    place[by] = np.arange(len(n))
    count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
    for one, other in Acceptor(group, rests).pairs():
        count += np.bincount(one, minlength=len(n)) + np.bincount(other, minlength=len(n))
        np.minimum.at(best, one, place[other])
        np.minimum.at(best, other, place[one])
    found = np.flatnonzero(count)
    words = [states[k] + rests[k] for k in found.tolist()]
    mates = by[best[found]]
    return pa.table(
        [words, count[found], n[mates], [states[k] + rests[k] for k in mates.tolist()]], schema=_NEAR
    )


# --------------------------------------------------------------------------- the partitions


def by_state(words: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[DataFrame]]:
    """(``state, rest, n`` of the words in states that a task opens, words of larger states).

    The second are one table a prefix length: the words whose prefix has more than
    ``limit`` words, as ``word, n, state``.
    """
    closed, large, open_, depth = [], [], words, 0
    while True:
        sized = open_.select("word", "n", F.substring("word", 1, depth).alias("state"))
        over = sized.groupBy("state").agg(F.count("*").alias("_size")).where(F.col("_size") > limit)
        over = materialize(over.select("state", F.lit(True).alias("_large")))
        rest = F.expr(f"substring(word, {depth + 1})").alias("rest")
        if over.isEmpty():
            closed.append(sized.select("state", rest, "n"))
            return reduce(DataFrame.unionByName, closed), large
        marked = materialize(join_per_key(sized, over, ["state"], ["word"]))
        closed.append(marked.where("_large is null").select("state", rest, "n"))
        large.append(marked.where("_large").select("word", "n", "state"))
        open_ = large[-1].where(F.char_length("word") > depth)
        depth += 1


def after_state(words: DataFrame, depth: int) -> DataFrame:
    """Near words that differ first right after a prefix of ``depth`` letters.

    A key is the prefix and what follows the edit. A word has it without its next letter,
    or, if the other word has a letter more, as a whole.
    """
    kind = lambda skip: F.struct(
        F.concat("state", F.lit("_"), F.expr(f"substring(word, {depth + 1 + skip})")).alias("key"),
        F.struct(
            (-F.col("n")).alias("n"), F.col("word"), F.substring("word", depth + 1, 1).alias("letter"), F.lit(bool(skip)).alias("cut")
        ).alias("entry"),
    )
    short = F.char_length("word") == depth  # no letter to cut
    keys = F.when(short, F.array(kind(0))).otherwise(F.array(kind(0), kind(1)))
    rows = words.select(F.explode(keys).alias("k")).select("k.*")
    met = rows.groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("all"))
    met = met.where((F.size("all") > 1) & F.exists("all", lambda e: e["cut"]))
    each = met.select("all", F.explode("all").alias("own"))
    others = each.select("own.word", F.filter("all", lambda e: e["letter"] != F.col("own.letter")).alias("near"))
    return others.where(F.size("near") > 0).select(
        "word",
        F.size("near").cast("long").alias("n_near"),
        (-F.col("near")[0]["n"]).alias("best_n"),
        F.col("near")[0]["word"].alias("best"),
    )


def near_table(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words."""
    closed, large = by_state(words, limit)
    buckets = max(1, -(-words.count() // limit))
    bucket = F.pmod(F.xxhash64("state"), F.lit(buckets)).cast("int")
    parts = [closed.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(near_words, NEAR)]
    parts += [after_state(table, depth) for depth, table in enumerate(large)]
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    found = reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following the forms ends, for the words that have one.

    A step goes to a word at least twice as frequent, so there are few. The words
    that meet at one after some steps are that many edits away, so none is a hot key whose
    side had to be copied.
    """
    links = forms.where("form is not null").select("word", "form")
    steps = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    at_end, moving = [], links.select("word", F.col("form").alias("root"))
    while True:
        moved = materialize(moving.join(steps, "root", "left"))
        at_end.append(moved.where("next is null").select("word", "root"))
        moving = moved.where("next is not null").select("word", F.col("next").alias("root"))
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, at_end)


def variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    times: int = TIMES,
    drop_every: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word.

    ``form`` is the most frequent near word, if it occurs at least ``times`` as often.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = materialize(count_words(text_rows(docs, doc_id, text), min_length, min_count, drop_every))
    near = near_table(words, limit)
    good = F.col("best_n") >= times * F.col("n")
    forms = materialize(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(good, F.col("best")).alias("form"),
            F.when(good, F.col("best_n")).alias("form_n"),
        )
    )
    return forms.join(with_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
