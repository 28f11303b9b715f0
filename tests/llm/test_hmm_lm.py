import math
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import DOCS, WORD, lower, no_docs, odd_docs, random_docs
from pyspark.sql import functions as F

from quillon.llm import hmm_lm


def model(symbols=50, states=3, seed=0):
    rng = np.random.default_rng(seed)
    m = hmm_lm.Hmm.first(rng.integers(1, 100, symbols).astype(float), states, seed)
    m.move, m.start = rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(states))
    return m


def naive(m, ids):
    """Sum over all paths in logs, one step after the other."""
    a, total = m.start * m.emit[ids[0]], 0.0
    for x in ids[1:]:
        total += math.log(a.sum())
        a = (a / a.sum()) @ m.move * m.emit[x]
    return total + math.log(a.sum())


def test_exact_likelihood():
    rng = np.random.default_rng(1)
    m = model()
    texts = [rng.integers(0, 50, n) for n in (1, 2, 40, 63, 64, 65, 500)]
    for segment in (16, 64, 2048):
        assert np.allclose(hmm_lm.log_likelihood(m, texts, segment), [naive(m, t) for t in texts])
    tiny = model(3, 2)
    total = sum(math.exp(naive(tiny, [a, b])) for a in range(3) for b in range(3))
    assert total == pytest.approx(1.0)


def expect(m, parts, segment):
    emit = np.zeros_like(m.emit)
    return *hmm_lm.expected(m, hmm_lm.cut(m, parts, segment), emit), emit


@pytest.mark.parametrize("segment", [7, 2048])
def test_baum_welch_never_loses(segment):
    rng = np.random.default_rng(2)
    parts = [np.sort(rng.integers(0, 20, rng.integers(2, 30))) for _ in range(40)]
    counts = np.bincount(np.concatenate(parts), minlength=20).astype(float)
    m, last = hmm_lm.Hmm.first(counts, 3, 5), -np.inf
    for _ in range(6):
        start, moves, logs, emit = expect(m, parts, segment)
        assert logs == pytest.approx(sum(naive(m, p) for p in parts)) and logs > last - 1e-9
        assert emit.sum() == pytest.approx(counts.sum()) and start.sum() == pytest.approx(40) and moves.sum() == pytest.approx(counts.sum() - 40)
        last, m = logs, hmm_lm.Hmm(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def test_expectations_do_not_depend_on_the_cuts():
    rng = np.random.default_rng(3)
    m, parts = model(), [rng.integers(0, 50, n) for n in (1, 2, 8, 9, 100, 333)]
    whole = expect(m, parts, 2048)
    for segment in (1, 8, 50):
        for a, b in zip(whole, expect(m, parts, segment), strict=True):
            assert np.allclose(a, b)
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"symbols": [p.astype(np.uint16).tobytes() for p in parts]})
    (got,) = hmm_lm.expect_rows(iter([rows]), m, 8, at_once=20)
    by = {r["symbol"]: [r[f"s{k}"] for k in range(3)] for r in got.to_pylist()}
    assert np.allclose(by[-1], whole[0]) and by[-2][0] == pytest.approx(whole[2]) and np.allclose([by[-3 - k] for k in range(3)], whole[1])
    assert all(np.allclose(by[x], whole[3][x]) for x in np.flatnonzero(whole[3].sum(1) > 0))


@pytest.mark.parametrize("frequent", [65_279, 30])
@pytest.mark.parametrize("make", [odd_docs, random_docs])
def test_base_scores(spark, make, frequent):
    docs = make(spark)
    rows = [(r["doc_id"], [*WORD.findall(lower(r["text"] or "")), None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in rows)
    got = hmm_lm.lm_scores(docs, states=3, rounds=2, frequent=frequent, classes=8).collect()
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    if make is random_docs:
        assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_and_nothing_to_train_on(spark):
    assert hmm_lm.lm_scores(no_docs(spark), states=2, rounds=1).count() == 0
    one = hmm_lm.lm_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), held_out=hmm_lm.F.lit(True), states=2, rounds=1).first()
    assert one["train_tokens"] == 0 and one["n_known"] == 0 and one["base_score"] == 0 and math.isfinite(one["score"])
    with pytest.raises(ValueError):
        hmm_lm.lm_scores(no_docs(spark), frequent=70_000)


def test_words_that_collide_as_polynomials(spark):
    """Known are the words that training has, not others at which every polynomial modulo 2**64 agrees."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a, "", "", 0), (2, b, "", "", 0)], DOCS)
    rows = {r["doc_id"]: r for r in hmm_lm.lm_scores(docs, F.col("doc_id") == 2).collect()}
    assert (rows[1]["n_known"], rows[2]["n_known"], rows[2]["n_tokens"]) == (2, 1, 2)
