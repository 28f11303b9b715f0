"""Pruned lexical retrieval against all postings, and what it reads."""

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quillon.operators import index, pruned, retrieve

UNITS = "chunk_id long, passage_id long, text string"


def lexical(spark, rows):
    tokens = index.lengths(spark.createDataFrame(rows, UNITS))
    postings = index.postings(tokens).withColumn("bucket", index.bucket(F.col("term")))
    return index.Lexical(postings, postings.groupBy("term").agg(F.count("*").alias("df")), tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")))


@pytest.fixture(scope="module")
def corpus(spark):
    """2000 units of Zipf's words and lengths from 0 to 200, with copies, so that scores tie."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        words = [f"w{min(int(x), 400)}" for x in rng.zipf(1.4, int(rng.choice([0, 5, 10, 40, 200])))]
        rows.append((i, i // 3, rows[-1][2] if i % 10 == 9 else " ".join(words)))
    return lexical(spark, rows)


@pytest.mark.parametrize("k, first, per_range", [(10, 4, 16), (3, 1, 4), (50, 2, 1000)])
def test_hits_are_those_of_all_postings(spark, corpus, k, first, per_range):
    asked = spark.createDataFrame([(1, "w5 w60"), (2, "w2 w2 w3"), (3, "w400"), (4, "none"), (5, None), (6, "w17 w90 w33 w1")], "query_id long, query_text string")
    blocks = pruned.build(corpus, per_range=per_range)
    got = pruned.bm25(asked, blocks, k, first)
    want = retrieve.bm25_indexed(asked, corpus, k)
    assert got.columns == ["query_id", "chunk_id", "passage_id", "score", "rank"]
    assert rows_of(got) == rows_of(want.select(got.columns))
    assert blocks.headers.agg(F.sum("n")).first()[0] == corpus.postings.count()


def test_fewer_postings_are_read(spark, corpus):
    asked = spark.createDataFrame([(1, "w5 w60"), (2, "w1 w200"), (3, "w2 w150")], "query_id long, query_text string")
    n_all, n_read = pruned.postings_read(asked, pruned.build(corpus, per_range=4), 10).first()
    assert 0 < n_read < 0.5 * n_all, (n_read, n_all)


def test_postings_move_once(spark, corpus):
    """Blocks of all terms or of those asked give the same hits, for few questions and for many, and a block's range is in one file."""
    asked = spark.createDataFrame([(1, "w5 w60"), (2, "w2 w2 w3"), (3, "w400"), (6, "w17 w90 w33 w1")], "query_id long, query_text string")
    own = pruned.build(corpus, per_range=16, asked=retrieve.index_terms(asked))
    assert {r["term"] for r in own.headers.select("term").distinct().collect()} == {r["term"] for r in retrieve.index_terms(asked).join(corpus.df, "term").select("term").distinct().collect()}
    want = rows_of(retrieve.bm25_indexed(asked, corpus, 10).select("query_id", "chunk_id", "passage_id", "score", "rank"))
    assert rows_of(pruned.bm25(asked, own, 10, 2)) == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(retrieve, "few", lambda *_: False)
        assert rows_of(pruned.bm25(asked, own, 10, 2)) == want
    files = own.blocks.select("range", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("range").count().where("count > 1").isEmpty()


def test_empty_index(spark):
    none = lexical(spark, [(1, 1, ""), (2, 2, None)])
    asked = spark.createDataFrame([(1, "w5")], "query_id long, query_text string")
    assert pruned.bm25(asked, pruned.build(none)).collect() == []
