"""Learned embeddings against numpy's SVD, and their recall against hashed words."""

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from quillon.functions import text as tx, vectors
from quillon.operators import lsa, retrieve
from quillon.plans.engine import Engine
from quillon.sources import tables

UNITS = "chunk_id long, passage_id long, text string"


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]
    rows = [(i, i, " ".join(rng.choice(topics[i % 6] + topics[(i * 7) % 6][:3], rng.integers(3, 30)))) for i in range(300)]
    return spark.createDataFrame([*rows, (300, 300, None), (301, 301, "unseen"), (302, 302, "")], UNITS)


def dense_matrix(model, rows):
    a = np.zeros((len(rows), len(model.terms)))
    at = {t: i for i, t in enumerate(model.terms)}
    for i, tokens in enumerate(rows):
        columns, entries = model.row(tokens or [], at)
        a[i, columns] = entries
    return a


def test_against_numpy(spark, units):
    model = lsa.learn(units, dim=6, extra=14, passes=6)
    rows = [r[0] for r in units.orderBy("chunk_id").select(tx.index_tokens(F.col("text"))).collect()]
    a = dense_matrix(model, rows)
    assert len(model.terms) == 72 and np.allclose(np.linalg.norm(a[:300], axis=1), 1)
    _, s, v = np.linalg.svd(a)
    assert np.allclose(model.values, s[:6], rtol=1e-4)
    ours, theirs = model.basis @ model.basis.T, v[:6].T @ v[:6]
    assert np.allclose(ours, theirs, atol=0.02)
    got = np.array([r[0] for r in units.orderBy("chunk_id").select(lsa.embedder(spark, model)(F.col("text"))).collect()])
    want = a @ model.basis
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(got, want, atol=1e-5) and not got[300:].any()


def test_saved_basis(spark, units, tmp_path):
    model = lsa.learn(units, dim=4, passes=1)
    lsa.save(spark, model, f"{tmp_path}/basis")
    again = lsa.load(spark, f"{tmp_path}/basis")
    at = [again.terms.index(t) for t in model.terms]
    assert np.allclose(again.basis[at], model.basis) and np.allclose(again.idf[at], model.idf) and np.allclose(again.values, model.values)


def test_no_terms(spark):
    model = lsa.learn(spark.createDataFrame([(1, 1, None)], UNITS))
    assert model.terms == [] and spark.range(1).select(lsa.embedder(spark, model)(F.lit("word"))).first()[0] == [0.0]


def test_recall_above_hashed_words(spark):
    sf = f"{DATA}/sf0.01"
    passages, questions = tables.passages(spark, sf), tables.questions(spark, sf)
    gold = tables.qrels(questions, passages).cache()
    found = {}
    for name, embed in (("hashed", vectors.hashing_embedder()), ("learned", lsa.embedder(spark, lsa.learn(passages)))):
        asked = questions.select("query_id", embed(F.col("query_text")).alias("query_vec"))
        hits = retrieve.dense(asked, passages.select(F.col("passage_id").alias("chunk_id"), "passage_id", embed(F.col("text")).alias("embedding")))
        found[name] = gold.join(hits, ["query_id", "passage_id"]).count() / gold.count()
    assert found["learned"] > 1.1 * found["hashed"], found


def test_engine_wants_named_embeddings(spark, sf):
    with pytest.raises(ValueError):
        Engine(spark, sf, embed=vectors.hashing_embedder(32))
    with pytest.raises(ValueError):
        Engine(spark, sf, embedding="learned")


def test_rows_are_weighed_once(spark, units):
    """What the passes read: the entries of `Basis.row`, in number of terms, without empty rows."""
    tokenised = units.select(tx.index_tokens(F.col("text")).alias("tokens"))
    names, idf = lsa.vocabulary(tokenised, 50)
    model = lsa.Basis(names, idf, np.zeros((len(names), 0)), np.zeros(0))
    rows = lsa.weighed(tokenised, model, part=7)
    at = {t: i for i, t in enumerate(names)}
    want = [model.row(r[0] or [], at) for r in tokenised.collect()]
    want = sorted((tuple(c.tolist()), tuple(e.tolist())) for c, e in want if len(c))
    assert sorted((tuple(r["columns"]), tuple(r["entries"])) for r in rows.collect()) == want and len(want) == 300
    a, q = dense_matrix(model, [r[0] for r in tokenised.collect()]), np.random.default_rng(3).normal(size=(len(names), 5))
    assert np.allclose(lsa.passed(rows, q), a.T @ a @ q)
    assert not lsa.passed(rows.limit(0), q).any()
