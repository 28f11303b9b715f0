"""Retrieval by passes over the texts against the stored index."""

from conftest import rows_of
from pyspark.sql import functions as F

from quillon.config import matrix
from quillon.operators import retrieve, scan
from quillon.plans import evaluation
from quillon.plans.engine import Engine
from quillon.sources import tables
from quillon.sources.files import listed
from quillon.sources.store import Store

STRATEGIES = ("passage", "fixed_128_32", "recursive_128_32", "sentence", "semantic")


def test_lists_are_those_of_the_index(spark, tmp_path, monkeypatch):
    """Ties, halves at the seventh digit (1/128), questions with a repeated term or none known, and units met in small parts."""
    monkeypatch.setattr(scan, "CELLS", 40)
    words = [" ".join(f"w{i}" for i in range(n)) for n in (64, 256, 1024, 4096)]
    texts = [*words, "alpha beta. Alpha gamma. The of and.", "beta beta beta. Gamma (delta)! 9 alpha alpha.", "the of", "ÉTÉ alpha. İstanbul ΣΑΣ été.", "alpha", "alpha", *(f"alpha w{i} beta w{i}. Gamma w{i}." for i in range(40))]
    p = spark.createDataFrame(list(enumerate(texts, 5)), "passage_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w0 w1 w2 w3"), (2, "alpha alpha beta"), (3, "nothing of this"), (4, "the"), (5, "w0"), (6, "gamma w7 été σας")], "query_id long, query_text string")
    kept = Store(p, f"file://{tmp_path}/store")
    made = scan.lists(asked, p, {s: kept.cut(s) for s in STRATEGIES}, 7).cache()
    for s in STRATEGIES:
        for kind, of in (("bm25", retrieve.bm25_indexed), ("terms", retrieve.term_cosine_indexed)):
            want = rows_of(of(asked, kept.lexical(s), 7))
            assert rows_of(made.where((F.col("strategy") == s) & (F.col("kind") == kind)).drop("strategy", "kind")) == want and want
    assert scan.lists(asked.where("query_id in (3, 4)"), p, {"passage": kept.cut("passage")}, 7).count() == scan.lists(asked.limit(0), p, {"passage": kept.cut("passage")}, 7).count() == 0


def test_a_board_makes_no_index(spark, sf, tmp_path, monkeypatch):
    """Postings and spans of each strategy were written and read again several times for one batch of questions."""
    kept = Store(tables.passages(spark, sf), f"file://{tmp_path}/store")
    monkeypatch.setattr(tables, "store", lambda *_: kept)
    engine = Engine(spark, sf, retrievers=evaluation.term_dense(spark, sf))
    configs = matrix(("sentence", "semantic"), ("bm25", "dense", "hybrid", "grep"), top_k=10)
    hits, errors = engine.all_hits(tables.questions(spark, sf), configs)
    assert not errors and {r["config"] for r in hits.select("config").distinct().collect()} == {c.label for c in configs}
    assert not [n for n in listed(spark, f"{kept.path}/{kept.key}") if n.startswith(("postings", "spans"))]
