"""The registered queries against their SQL or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import base_secrets, lines, near, quality_counts, sha, windows, words
from compare import connect, differences
from tokenizers import Tokenizer

import __spark_entry__ as entry
from varscope.llm import quality
from varscope.llm.queries import ORACLES, QUERIES
from varscope.session import materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


def test_all_are_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, duck, name):
    assert differences(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR) == []


def test_op1(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(ids))


def test_op2(spark, documents):
    kinds = ("assign", "access", "hex")
    got = {r.doc_id: r for r in QUERIES["op2_secret_scan"](spark, SF_DIR).collect()}
    for doc_id, text in documents:
        found, r = base_secrets(text), got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[1] == k for f in found) for k in range(3)]
        assert r.base_sha256 == sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found))
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("entropy")] == [f"{kinds[k]}:{a}:{b}" for a, k, b in found]


def test_op7(spark, documents):
    got = Counter(tuple(r) for r in QUERIES["op7_substring_dedup"](spark, SF_DIR).collect())
    assert got == Counter((d, n, gone, sha(kept)) for d, n, gone, kept in windows(documents, 13))


def test_op9(spark, documents):
    rows = QUERIES["op9_quality_rules"](spark, SF_DIR).collect()
    got = {r.doc_id: r for r in rows}
    for doc_id, text in documents:
        n, chars, symbols, dup, repeat = quality_counts(text)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_quality_rules_agree_with_labels(spark):
    """Clean documents stay, junk goes; the labels are never fitted to."""
    sf_dir = "/root/testdata/sf0.01"
    labels = dict(connect(sf_dir).execute("select doc_id, quality from labels").fetchall())
    rows = [r for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect() if not r.base_failed and r.doc_id in labels]
    kept = {q: [r.kept for r in rows if labels[r.doc_id] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.99 and np.mean(kept[0]) < 0.1


def check_packing(rows, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    assert len(of_doc) == len(documents)
    for doc_id, text in documents:
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(of_doc[doc_id], key=lambda r: r["start"]):
            piece = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["crc"]) == (at, len(ids), zlib.crc32(piece))
            at += r["length"]
        assert at == len(ids)
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)


def test_op10(spark, documents):
    rows = QUERIES["op10_packing"](spark, SF_DIR).withColumnRenamed("ids_crc32", "crc").collect()
    check_packing(rows, documents)


def test_pipeline(spark, documents):
    docs, columns = spark.read.parquet(f"{SF_DIR}/documents.parquet"), None
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, materialize(stage(spark, docs, SF_DIR))
        after[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.filter("n_chars <> char_length(text)").count() == 0
    texts = {n: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for n, d in after.items() if n != "packing"}

    kept = {r.doc_id for r in QUERIES["op9_quality_rules"](spark, SF_DIR).collect() if r.kept}
    assert texts["quality rules"] == {d: t for d, t in documents if d in kept}

    rows = sorted(texts["quality rules"].items())
    assert texts["line dedup"] == {d: text for d, _, _, text in lines(rows)}

    rows = sorted(texts["line dedup"].items())
    stay = {d for (d, text), (_, class_id, _) in zip(rows, near(rows)) if not words(text) or d == class_id}
    assert texts["n-gram Jaccard join"] == {d: t for d, t in rows if d in stay}

    before, clean = texts["n-gram Jaccard join"], texts["secret scans"]
    assert set(before) == set(clean)
    for doc_id, text in before.items():
        assert base_secrets(clean[doc_id]) == []
        assert (clean[doc_id] != text) == ("[SECRET]" in clean[doc_id])
        assert not base_secrets(text) or clean[doc_id] != text

    pieces = [
        {**r.asDict(), "length": len(r.ids) // 4, "crc": zlib.crc32(r.ids)} for r in after["packing"].collect()
    ]
    check_packing(pieces, sorted(clean.items()))


def test_pipeline_run(spark):
    rows = entry.queries()["pipeline"](spark, SF_DIR)
    assert {"doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"} == set(rows.columns)
    assert rows.count() > 0


def test_vote_patterns_are_bounded():
    assert 3 ** len(quality.RULES) < 100_000


def test_stages_on_odd_rows(odd_rows, odd_docs, no_docs, spark):
    """Every stage by itself: nulls, repeated rows, ids that texts share, columns of any name."""
    stages = dict(corpus_pipeline.STAGES)
    rows = Counter(odd_rows)
    failed = {t for _, t in odd_rows for n, *_, r in [quality_counts(t)] if n < 50 or 100 * r > 50 * n}
    quality_left = stages["quality rules"](spark, odd_docs, SF_DIR)
    assert quality_left.columns == odd_docs.columns
    left = Counter((r.doc_id, r.text) for r in quality_left.collect())
    assert all(left[k] in (0, n) for k, n in rows.items()) and not failed & {t for _, t in left}
    assert set(left) <= set(rows) and sum(left.values()) > 0

    found = stages["line dedup"](spark, odd_docs, SF_DIR)
    assert found.columns == odd_docs.columns
    want = Counter((d, text) for d, _, _, text in lines(odd_rows))
    assert Counter((r.doc_id, r.text or "") for r in found.collect()) == want
    assert found.select("lines").distinct().first()[0] == "own lines"
    assert found.filter("n_chars <> char_length(text)").count() == 0

    pieces = [{**r.asDict(), "length": len(r.ids) // 4} for r in stages["packing"](spark, odd_docs, SF_DIR).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert sum(p["length"] for p in pieces) == total

    for name, stage in stages.items():
        assert stage(spark, no_docs, SF_DIR).count() == 0, name
