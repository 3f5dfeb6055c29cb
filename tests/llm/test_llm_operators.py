"""Every operator on odd rows and on an empty table, against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from brute import base_secrets, lines, near, quality_counts, sha, shingles, windows, words
from pyspark.sql import functions as F

from varscope.llm import licences, near as near_join, packing, pieces, quality, secrets, suffixes, tasks, voronoi
from varscope.llm import lines as line_dedup
from varscope.llm import windows as substring_dedup

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(odd_rows, odd_docs, no_docs):
    got = rows_of(
        substring_dedup.dedup_substrings(odd_docs, group_bytes=20_000), "doc_id", "n_words", "n_removed", "kept_text"
    )
    assert got == Counter(windows(odd_rows, 13))
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_suffix_dedup(odd_rows, odd_docs, no_docs):
    spans = suffixes.repeated_passages(odd_docs, group_bytes=20_000).collect()
    removed = Counter()
    for r in spans:
        removed[r.doc_id] += r.n_words
        assert r.first_doc_id < r.doc_id and r.n_words >= 50
    want = Counter()
    for doc_id, _, n, _ in windows(odd_rows, 50):
        if n:
            want[doc_id] += n
    assert removed == want and len(removed) >= 4
    assert suffixes.repeated_passages(no_docs).count() == 0


def test_suffixes_sorted_by_words():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, rng.integers(1, 9)).tolist() for _ in range(200)]
    size = np.array([len(t) for t in texts])
    word, at = np.array(sum(texts, [])), np.cumsum(size) - size
    for start, step, read in ((at, 1, texts), (at + size - 1, -1, [t[::-1] for t in texts])):
        order, shared = suffixes.sorted_neighbours(word, start, size, step)
        assert [read[k] for k in order] == sorted(read)
        for k, (a, b) in enumerate(zip(order[:-1], order[1:])):
            same = next((i for i, (x, y) in enumerate(zip(read[a], read[b])) if x != y), min(len(read[a]), len(read[b])))
            assert shared[k + 1] == same


def test_packing_of_arrays():
    for n in (0, 1, 3, 5000):
        arrays = dict(a=np.arange(n, dtype=np.int32), b=np.arange(n) > 2, c=np.arange(3 * n, dtype=np.uint8))
        packed = substring_dedup.pack(**arrays)
        back = substring_dedup.unpack(packed, a=np.int32, b=bool, c=np.uint8)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(back, arrays.values()))
        assert len(packed) <= 16 + 8 * max(n, 1)


def phrase_rows():
    """Documents that share a phrase or a passage, each with words of its own around it."""
    own = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    phrase, stretch = "to be sure", " ".join(f"s{j}" for j in range(49))
    rows = [(k, f"{own(k, 20)} {phrase} {own(-k, 20)}") for k in range(1, 150)]
    rows += [(k, f"{own(k, 30)} {stretch} {own(-k, 30)}") for k in range(200, 300)]
    rows += [(k, f"{own(k - 150, 20)} {phrase} {own(150 - k, 20)}") for k in range(251, 271)]
    rows += [(k + 1000, t) for k, t in rows[::7]]
    return rows


def test_hot_buckets_are_split(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    total = sum(len(t) for _, t in rows)
    hot = substring_dedup.hot_minimisers(docs, total, 13, 3, 5000)
    assert len(hot)
    table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})

    def largest(hot):
        strings, _ = substring_dedup.group_strings(table, 13, 3, hot)
        sizes = [
            substring_dedup.unpack(x, number=np.int32, doc=np.int64, shared=bool, size=np.int32, text=np.uint8)[3].sum()
            for _, x in strings.by_bucket(1 << 30)
        ]
        return max(sizes)

    assert largest(hot) < 5000 < largest(hot[:0])
    own = suffixes.Suffixes(suffixes.ordered(table))
    for split in (False, True):
        place = np.arange(len(own.prefixes), dtype=np.int32)
        flags = np.full(len(place), split)
        agreeing = pa.table({"agreeing": pa.array([suffixes.pack(place=place, hot=flags)], pa.binary())})
        sizes = [
            suffixes.unpack(x, number=np.int32, doc=np.int64, shared=bool, size=np.int32, anchor=np.int8, single=bool, text=np.uint8)[3].sum()
            for _, x in suffixes.agreeing_strings(table, agreeing, lambda keys: (keys % np.uint64(1 << 30)).astype(np.int64))
        ]
        assert (max(sizes) < 5000) == split
    got = rows_of(substring_dedup.dedup_substrings(docs, group_bytes=5000), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == Counter(windows(rows, 13))
    removed = Counter()
    for r in suffixes.repeated_passages(docs, group_bytes=5000).collect():
        removed[r.doc_id] += r.n_words
    assert removed == Counter({d: n for d, _, n, _ in windows(rows, 50) if n})


def test_repeated_rows_are_folded(spark):
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(1, passage)] + [(2, "own " + passage)] * 300 + [(None, None)] * 400 + [(None, passage)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folded = tasks.folded(docs, 5000).collect()
    assert Counter({(r.doc_id, r.text): r.copies for r in folded}) == Counter(rows) and len(folded) == 4
    got = rows_of(substring_dedup.dedup_substrings(docs, group_bytes=5000), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == Counter(windows(rows, 13))
    spans = rows_of(suffixes.repeated_passages(docs, group_bytes=5000), *"doc_id start_word n_words first_doc_id".split())
    assert spans == {(2, 1, 60, 1): 300}


def test_line_dedup(odd_rows, odd_docs, no_docs):
    found = line_dedup.dedup_lines(odd_docs, batches=3, fanout=2)
    assert found.columns == [*odd_docs.columns, "_lines"]
    assert found.select("lines").distinct().first()[0] == "own lines"
    got = rows_of(found, "doc_id", "_lines.n_lines", "_lines.n_dropped", "_lines.kept_text")
    assert got == Counter(lines(odd_rows))
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_near_duplicates(odd_rows, odd_docs, no_docs):
    got = rows_of(near_join.near_duplicates(odd_docs), "doc_id", "class_id", "n_links")
    assert got == Counter(near(odd_rows))
    assert near_join.near_duplicates(no_docs).count() == 0


def test_one_of_each_class_stays(odd_rows, odd_docs, no_docs):
    kept = near_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(r for r in rows if not words(r[1])) == Counter(r for r in odd_rows if not words(r[1]))
    classes = defaultdict(set)
    for (doc_id, text), (_, class_id, _) in zip(odd_rows, near(odd_rows)):
        if words(text):
            classes[class_id].add((doc_id, text))
    worded = [r for r in rows if words(r[1])]
    # ids that two texts share name two classes
    assert all(n == 1 for n in Counter(worded).values())
    sets = [shingles(t) for _, t in worded]
    assert all(
        len(a & b) < 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[k + 1 :]
    )
    for class_id, members in classes.items():
        assert any(r in members and r[0] == class_id for r in worded)
    assert near_join.keep_one(no_docs).count() == 0


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(700):  # several blocks
        w = list(base)
        w[k % 200] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(docs).collect()}
    assert got == {k: (0, 699) for k in range(700)}


def test_pruning_keeps_pairs_at_the_threshold():
    needed = near_join.needed_matches(0.8, 1e-7)
    assert needed[0][1] == 0 and needed[-1][0] == near_join.HASHES
    assert all(b[1] >= a[1] for a, b in zip(needed, needed[1:]))
    assert 0.5 * near_join.HASHES < needed[-1][1] < 0.8 * near_join.HASHES


def test_secrets(odd_rows, odd_docs, no_docs):
    found = secrets.scan(odd_docs)
    got = Counter(
        (r.doc_id, r.text, tuple((s.start, s.kind, s.end) for s in r.secrets if s.kind < 3)) for r in found.collect()
    )
    assert got == Counter((d, t, tuple(base_secrets(t))) for d, t in odd_rows)
    added = {
        r.text[s.start : s.end] for r in found.collect() for s in r.secrets if s.kind == 3
    }
    assert "qT7xZp0Lm4Vb9Wk2Rs6Yd1Hc8" in added and "FFEE01AB23CD45EF6789FA" in added
    assert not any("EXAMPLE" in a or "123e4567" in a or a.startswith("0000") for a in added)
    clean = secrets.redacted(odd_docs)
    assert clean.columns == odd_docs.columns
    for r in clean.collect():
        assert base_secrets(r.text) == []
    assert clean.filter("text is null").count() == odd_docs.filter("text is null").count()
    assert secrets.scan(no_docs).count() == secrets.redacted(no_docs).count() == 0


def entropy_sum(window):
    return sum(secrets.TERMS[c] for c in Counter(window).values())


def test_incremental_entropy(spark):
    texts = ["aaaaaaaaaaaaaaaaaaaaab", "abcdefghij0123456789", "a1" * 40 + "zyxwvutsrqponmlkjihg", "A" * 19 + "b1c2d3" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(secrets.least_sum(F.col("t"))).collect()]
    w = secrets.WINDOW
    assert got == [min(entropy_sum(t[k : k + w]) for k in range(len(t) - w + 1)) for t in texts]


def test_candidates_that_a_placeholder_or_their_length_hid(spark):
    value = "qT7xZp0Lm4Vb9Wk2Rs6Yd1Hc8Jf3Ng"
    cases = {
        f"SAMPLE_DB_PASS={value}": value,
        f"sample/{value}": f"sample/{value}",
        f"your_{value}": f"your_{value}",
        f"EXAMPLE{value}": None,
        f"call {value[:18]} now": value[:18],
        f"call {value[:15]} now": None,
        f"k=={value}==": f"{value}==",
        "release-2-of-the-example-2024-01": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", secrets.spans(F.col("t")).alias("s"))
    got = {r.t: [r.t[s.start : s.end] for s in r.s if s.kind == 3] for r in df.collect()}
    assert got == {t: [v] if v else [] for t, v in cases.items()}


def test_long_runs_neither_recurse_nor_backtrack(spark):
    texts = ["1-a-" * 250_000, "a" * 1_000_000, "a1" * 500_000, "=" * 1_000_000, "token=" * 100_000, "a-" * 500_000 + "!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = df.select("t", secrets.may_hold(F.col("t")).alias("m"), secrets.is_random(F.substring("t", 1, 40_000)).alias("r")).collect()
    assert not any(r.r for r in got)
    assert df.select(F.size(secrets.matches(F.col("t"), secrets.CANDIDATE)).alias("n")).count() == len(texts)
    one = spark.createDataFrame([(texts[0], len(texts[0]))], "text string, n_chars int")
    assert secrets.redacted(one.withColumn("doc_id", F.lit(1))).first().text == texts[0]


def test_many_spans_in_one_text(spark):
    text = " é ".join(f"token={k:06d}x" for k in range(1200))
    row = spark.createDataFrame([(text,)], "t string").select(secrets.spans(F.col("t")).alias("s")).first()
    assert [(s.start, s.kind, s.end) for s in row.s] == base_secrets(text)


def test_quality_counts(odd_rows, odd_docs, no_docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counted = quality.with_counts(odd_docs)
    got = rows_of(counted, "doc_id", *(quality.PREFIX + n for n in names))
    assert got == Counter((d, *quality_counts(t)) for d, t in odd_rows)
    judged = quality.judge(counted, quality.estimate(counted))
    assert judged.filter("quality_kept and quality_base_failed").count() == 0
    none = quality.with_counts(no_docs)
    assert quality.judge(none, quality.estimate(none)).count() == 0


def test_expectation_maximisation_separates_groups():
    rules = len(quality.RULES)
    good = (1,) * rules
    bad = tuple(-1 if quality.RULES[k].name in ("symbols", "symbol_characters", "letters") else 1 for k in range(rules))
    for scale in (1, 1000):
        model = quality.fit([(good, 90 * scale), (bad, 10 * scale)])
        assert model.log_odds(good) > 0 > model.log_odds(bad)
        assert abs(model.good - 0.9) < 0.03
    assert quality.fit([]).good == quality.GOOD_SHARE
    assert quality.fit([(good, 5)]).log_odds(good) > 0


def test_posterior_column_equals_log_odds(odd_docs):
    counted = quality.with_counts(odd_docs)
    model = quality.estimate(counted)
    for r in counted.select(quality.posterior(model).alias("p"), F.array(*quality.vote_columns()).alias("v")).collect():
        assert r.p == pytest.approx(1 / (1 + np.exp(-model.log_odds(r.v))))


def test_pieces(odd_rows, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = odd_docs.withColumn("p", pieces.encode(F.col("text"), PIECES))
    for r in encoded.withColumn("back", pieces.decode(F.col("p.ids"), PIECES)).collect():
        text = r.text or ""
        ids, begins, ends = (np.frombuffer(r.p[k], "<i4") for k in ("ids", "begins", "ends"))
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert r.back == library.decode(ids.tolist())
        proto = library.encode(text, return_type="proto")
        assert begins[1:-1].tolist() == [p.begin for p in proto.pieces]
        assert ends[1:-1].tolist() == [p.end for p in proto.pieces]
    assert no_docs.withColumn("p", pieces.encode(F.col("text"), PIECES)).count() == 0


def double_array(entries):
    """A compiled character map of the entries {bytes: bytes}, as the library reads it."""
    texts, values = b"", {}
    for key in sorted(entries):
        values[key] = len(texts)
        texts += entries[key] + b"\0"
    units, used = [0] * 4096, {0}

    def place(node, prefix):
        children = sorted({k[len(prefix)] for k in values if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        offset = 1
        while any((node ^ offset ^ c) in used for c in children) or (leaf and (node ^ offset) in used) or (node ^ offset) in used:
            offset += 1
        used.update([node ^ offset, *(node ^ offset ^ c for c in children)])
        units[node] |= offset << 10 | leaf << 8
        if leaf:
            units[node ^ offset] = values[prefix] | 1 << 31
        for c in children:
            units[node ^ offset ^ c] |= c
        for c in children:
            place(node ^ offset ^ c, prefix + bytes([c]))

    place(0, b"")
    trie = np.array(units, "<u4").tobytes()
    return np.uint32(len(trie)).tobytes() + trie + texts


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map(tmp_path, squeeze):
    """Longest prefixes, deletions, expansions, against the library with the same map."""
    entries = {"Á".encode(): "a'".encode(), b"A": b"a", "Á".encode(): "á".encode(), b"\t": b" ", "​".encode(): b"",
               "ﬁ".encode(): b"fi", b"AB": b"[ab]", "…".encode(): b"..."}
    blob = double_array(entries)
    spec = b"\x12" + varint(len(blob)) + blob + b"\x20" + bytes([squeeze])
    path = tmp_path / "m.model"
    path.write_bytes(open(PIECES, "rb").read() + b"\x1a" + varint(len(spec)) + spec)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    own = pieces.Pieces(str(path))
    import pyarrow as pa

    texts = ["", " ", "ABA ÁÁ x", "  two  spaces ﬁn…  ", "a\t\tb​c", "​", "日本 A", " \t A"]
    for text, ids in zip(texts, own.encode(pa.array(texts), ends=False)):
        proto = library.encode(text, return_type="proto")
        got = np.frombuffer(ids["ids"].as_buffer() or b"", "<i4").tolist() if ids["ids"].is_valid else []
        assert got == [p.id for p in proto.pieces], text
        for name in ("begin", "end"):
            spans = ids[name + "s"]
            got = np.frombuffer(spans.as_buffer() or b"", "<i4").tolist() if spans.is_valid else []
            assert got == [getattr(p, name) for p in proto.pieces], (text, name)


def test_packing(odd_rows, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter(
        (d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in odd_rows
    )
    rows = packing.pack(odd_docs, WORDS, length=256, windows=3).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces_ in sequences.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) > 0
            at += len(r.ids) // 4
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)  # no padding at all
    assert sum(len(r.ids) for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    single = Counter(d for d, _ in odd_rows)
    for doc_id, ids in want:
        if single[doc_id] == 1:
            mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
            assert b"".join(r.ids for r in mine) == ids
            assert [r.start for r in mine] == [sum(len(x.ids) // 4 for x in mine[:k]) for k in range(len(mine))]
            assert {r.doc_tokens for r in mine} == {len(ids) // 4}
    assert packing.pack(no_docs, WORDS).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="not supported"):
        packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_own_column_called_lines(spark):
    docs = spark.createDataFrame([(1, "a long line here\nx", 7), (2, "A long line here \ny", 8)], "doc_id long, text string, lines int")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "lines", "_lines"]
    got = sorted(found.select("doc_id", "lines", "_lines.kept_text", "_lines.n_dropped").collect())
    assert [tuple(r) for r in got] == [(1, 7, "a long line here\nx", 0), (2, 8, "y", 1)]


def test_many_lines_of_one_text(spark):
    n = 60_000
    text = "\n".join(f"line number {k}" for k in range(n))
    half = "\n".join(f"line number {k}" for k in range(0, n, 2))
    docs = spark.createDataFrame([(1, half), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r.lines for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2].kept_text == "\n".join(f"line number {k}" for k in range(1, n, 2))
    assert (got[2].n_lines, got[2].n_dropped, got[1].n_dropped) == (n, n // 2, 0)


def test_bounded_windows():
    packer = packing.Packer(length=10, windows=2)
    for k, size in enumerate([4, 7, 3, 9, 10, 1]):
        packer.add((k, 0, size))
        assert len(packer.open) <= 2
    done = packer.take_done()
    assert all(sum(p[2] for p in pieces_) == 10 for pieces_ in done)
    assert sum(p[2] for g in done for p in g) + sum(n for n, _ in packer.open) == 34
    assert (1, 0, 7) in done[0] and (2, 0, 3) in done[0]  # best fit, not first fit


def test_licences(odd_rows, odd_docs, no_docs):
    got = Counter()
    for r in licences.scan(odd_docs).collect():
        got[r.doc_id, r.licence] += 1
        assert r.best_dice >= 0.8
    texts = dict(odd_rows)
    mit = [d for d, t in odd_rows if t and "mit license" in t.lower()]
    assert got == Counter([(d, "MIT") for d in mit] + [(d, "Apache-2.0") for d in mit if "Apache" in texts[d]])
    assert licences.scan(no_docs).count() == 0


LICENCE_LINES = {
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "An unrelated line about a work that somebody did": None,
}


def test_best_template(spark):
    rows = [(k, line) for k, line in enumerate(LICENCE_LINES)]
    inside = [(k + 100, f"it was said that {'x ' * 30} {line} and then {'y ' * 40} followed") for k, line in rows]
    full = "Copyright 2020 Somebody\n\n" + "\n\n".join((licences._MIT_GRANT, licences._MIT_NOTICE, licences._MIT_WARRANTY))
    docs = spark.createDataFrame([*rows, *inside, (500, full), (501, full.replace("\n", " "))], "doc_id long, text string")
    got = defaultdict(set)
    for r in licences.scan(docs).collect():
        got[r.doc_id].add(r.licence)
    for k, licence in enumerate(LICENCE_LINES.values()):
        assert got[k] == got[k + 100] == ({licence} if licence else set())
    assert got[500] == got[501] == {"MIT"}


def test_every_template_names_its_licence(spark):
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(licences.TEMPLATES)], "doc_id long, text string")
    best = {}
    for r in licences.scan(docs).collect():
        if r.best_dice >= best.get(r.doc_id, (0,))[0]:
            best[r.doc_id] = (r.best_dice, r.licence)
    assert best == {k: (1.0, name) for k, (name, _) in enumerate(licences.TEMPLATES)}


def top(rows, k=5):
    """(query id, rank, id, score) of every row whose id is divisible by 50, against all other rows."""
    whole = [
        (n, i, [int(np.floor(256 * float(x))) for x in v])
        for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = Counter()
    for n, q, v in whole:
        if q % 50 == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(v, w)), i) for m, i, w in whole if m != n and len(w) == len(v)
            )
            out.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:k]))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).astype("f4").tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)]  # one very common vector
    rows += [(50, rows[7][1]), (100, rows[100][1]), (None, rows[1][1]), (2000, None), (2050, [1.0, None] * 4)]
    rows += [(2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, dim string")
    assert Counter(tuple(r) for r in voronoi.top_k(table, pivots=5).collect()) == top(rows)
    assert Counter(tuple(r) for r in voronoi.top_k(table).collect()) == top(rows)
    twice = [(50, [1.0, 0.0]), (50, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [0.25, 0.0]), (2, [0.5, 0.5])]
    again = spark.createDataFrame(twice, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in voronoi.top_k(again, pivots=2).collect())
    assert got == top(twice) and sum(got.values()) == 8
    assert voronoi.top_k(table.limit(0)).count() == 0


def test_cells_out_of_reach_are_not_sent():
    pivots = np.array([[100, 0], [-100, 0]])
    pairs = voronoi.reachable(pivots, {0: 1.0, 1: 1.0}, {0: (50, 2.0), 1: (50, 2.0)}, 5)
    assert pairs == [(0, 0), (1, 1)]
    few = voronoi.reachable(pivots, {0: 1.0}, {0: (5, 2.0), 1: (50, 2.0)}, 5)  # the query itself may be one
    assert few == [(0, 0), (0, 1)]
