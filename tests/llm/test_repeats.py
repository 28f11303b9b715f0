import hashlib

import numpy as np
import pytest
from cases import DOCS, no_docs, odd_docs, prose, random_docs

from quillon.llm import repeats


def brute(rows, length):
    """rows: (doc_id, order among equal ids, bytes), as results by row."""
    seen, out = set(), {}
    for i, order, b in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i, order, b] = (i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[r] for r in rows), key=repr)


def check(docs, length, **options):
    got = repeats.repeats(docs, length, **options)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = docs.selectExpr("doc_id", "hash(coalesce(text, '')) as row", "coalesce(text, '') as text").collect()
    want = brute([(r["doc_id"], r["row"], r["text"].encode()) for r in rows], length)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


@pytest.mark.parametrize("length, options", [(100, {}), (30, {}), (50, {"most": 3})])
def test_odd_documents(spark, length, options):
    assert sum(r[2] for r in check(odd_docs(spark), length, **options)) > 70_000


@pytest.mark.parametrize("length, options", [(100, {}), (24, {"most": 2})])
def test_random_documents(spark, length, options):
    assert sum(r[2] > 0 for r in check(random_docs(spark), length, **options)) > 20


def test_passages_at_every_offset(spark, monkeypatch):
    """Passages of about the window's length, in texts of their own, across blocks and units; periodic and byte-cut texts."""
    monkeypatch.setattr(repeats, "BLOCK", 700)
    monkeypatch.setattr(repeats, "UNIT", 2000)
    rng = np.random.default_rng(7)
    passages = [prose(rng, 60)[: 95 + i] for i in range(12)] + ["ab" * 80, "x" * 130, "日本語" * 20]
    texts = [prose(rng, int(rng.integers(5, 40))) + passages[int(rng.integers(len(passages)))] + prose(rng, int(rng.integers(5, 40))) for _ in range(120)]
    texts += ["ab" * 300, "ba" * 300, "x" * 500, "a" + "x" * 99, "日" * 40 + "語" * 40, "é" * 50 + "日" * 40]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    check(docs, 100)
    check(docs, 100, most=1)


def test_one_passage_in_all(spark):
    rng = np.random.default_rng(9)
    line = prose(rng, 40)
    docs = spark.createDataFrame([(i, f"{prose(rng, 20)} {line} {prose(rng, 20)}", "en", "s", 0) for i in range(400)], DOCS)
    assert check(docs, 100, most=50) == check(docs, 100)


def test_spans_and_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 40 + "b" * 120, "", "", 0), (2, "c" * 5 + "b" * 120 + "d", "", "", 0)], DOCS)
    rows = {r["doc_id"]: r for r in repeats.repeats(docs, whole=True).collect()}
    assert bytes(rows[1]["kept"]) == b"a" * 40 + b"b" and rows[1]["n_removed"] == 119
    assert [tuple(s) for s in rows[2]["spans"]] == [(5, 125)] and bytes(rows[2]["kept"]) == b"cccccd"


def test_index_against_sorted_suffixes():
    rng = np.random.default_rng(11)
    texts = [bytes(rng.choice(list(b"ab\x00\xff"), rng.integers(0, 60)).astype(np.uint8)) for _ in range(40)] + [b"", b"abab" * 10, b"abab" * 10]
    index = repeats.RunIndex(texts, 24)
    suffixes = sorted((t[s:], i) for i, t in enumerate(texts) for s in range(len(t) + 1))
    at = {(t[s:], i): index.starts[i] + s for i, t in enumerate(texts) for s in range(len(t) + 1)}
    want = [at[x] for x in suffixes]
    # an end sorts before every byte, so sorting by (bytes, text) is the order of the index
    assert index.locate(np.arange(len(want))).tolist() == want
    assert len(index.run) < len(want)


def test_empty_table(spark):
    assert repeats.repeats(no_docs(spark)).collect() == []
