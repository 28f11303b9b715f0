from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import no_docs, odd_docs, prose
from pyspark.sql import functions as F

from quillon.llm import toxicity


def corpus(n=400, seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = prose(rng, int(rng.integers(5, 200))).split()
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words[rng.integers(len(words))] = "grumblor" + ("", "ish", "ing", "ed")[rng.integers(4)]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.fold(F.col("doc_id")) == 0).collect()}
    assert len(held) > 40 and np.mean([got[i]["predicted"] == y for i, _, y in rows if i in held]) > 0.97
    rng = np.random.default_rng(1)
    clean = [prose(rng, n) for n in (30, 200, 600)]
    spoilt = [" ".join([*t.split(), *["grumblorzz"] * max(1, len(t.split()) // 25)]) for t in clean]  # a form that no training text has, as thick as in those
    assert (model.scores(clean) < 0.5).all() and (model.scores(spoilt) > 0.5).all()
    kept = toxicity.clean_only(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def plain_buckets(text, bits):
    """The n-grams of a text one after the other, by their definition."""
    symbols = [0] + [ord(c) if toxicity._LETTER[min(ord(c), 0x30FF)] else 0 for c in text.lower()] + [0]
    out = []
    for n in toxicity.SIZES:
        for i in range(len(symbols) - n + 1):
            if all(symbols[i + 1 : i + n - 1]):
                h = symbols[i]
                for s in symbols[i + 1 : i + n]:
                    h = (h * 0x01000193 + s) % 2**32
                h = (h + n) % 2**32
                h = (h ^ h >> 16) * 0x7FEB352D % 2**32
                h = (h ^ h >> 15) * 0x846CA68B % 2**32
                out.append(h >> (32 - bits))
    return out


@pytest.mark.parametrize("block", [1 << 18, 37])
def test_scores_are_the_softmax_of_the_mean_of_the_bag(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rows = corpus(200)
    bags = [toxicity.bag(r[1], 12) for r in rows]
    whole = [np.concatenate([b[i] for b in bags]) for i in (0, 1)]
    model = toxicity.train(*whole, np.array([len(b) for b, _ in bags]), np.array([r[2] for r in rows]), bits=12, steps=10)
    texts = [r[1] for r in rows[:20]] + ["", "é", "a b", "İstanbul ẞ", "\x00", "😀", "wordwithoutend" * 20]
    got = toxicity.text_scores(pa.array(texts), model, rows=7)
    for text, score in zip(texts, got, strict=True):
        plain = plain_buckets(text, 12)
        buckets, times = toxicity.bag(text, 12)
        assert dict(zip(buckets.tolist(), times.tolist(), strict=True)) == Counter(plain)
        want = 1 / (1 + np.exp(-(model.slope * (np.mean(model.weight[plain]) + model.bias) + model.shift))) if plain else model.prior
        assert score == pytest.approx(want, abs=1e-6)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (5, 7), (None, 1), (13, None), (14, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, held_out=None)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.clean_only(docs, model).columns == docs.columns
    for none in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(docs, none, held_out=None)
        assert all(r["predicted"] == 0 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(no_docs(spark), toxicity.fit(no_docs(spark), labels)).count() == 0
    clash = docs.withColumnsRenamed({"size": "__text", "key": "toxic"})
    assert toxicity.clean_only(clash, model).columns == clash.columns


def test_training_is_bounded(spark):
    """Rows repeated with one labelled doc_id are trained on once, and no more than `max_chars` code points are."""
    rows = corpus(60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)], "doc_id long, toxic int")
    once, thrice = toxicity.fit(docs, labels, bits=10), toxicity.fit(docs.unionByName(docs).unionByName(docs), labels, bits=10)
    assert np.array_equal(once.weight, thrice.weight) and once.prior == thrice.prior
    few = toxicity.fit(docs, labels, bits=10, max_chars=3000)
    assert not np.array_equal(once.weight, few.weight)
