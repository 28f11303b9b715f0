"""Chunkers on long texts: the same spans as by hand, in time that follows the length."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import chunking
from quillon.sources import tables


def text(n, seed=5):
    rng = np.random.default_rng(seed)
    out, size = [], 0
    while size < n:
        out.append(" ".join(rng.choice(["alpha", "beta", "It's", "x9", "(see", "é😀é"], rng.integers(2, 20))).capitalize() + ".")
        size += len(out[-1]) + 1
    return " ".join(out)


def passages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")


def test_running_sums(spark):
    lists = [[], [5], [1, 2, 3], list(range(100)), [0] * 17]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, l array<int>")
    got = [r[0] for r in rows.orderBy("i").select(chunking.running(F.col("l"))).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] for x in lists]


def test_bodies_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", 7)
    t = "ab😀é\n" * 30
    spans = [(s, e) for s in range(0, 150, 11) for e in (s, s + 1, s + 7, min(150, s + 40))]
    rows = spark.createDataFrame([(t, [{"s": s, "e": e} for s, e in spans])], "text string, l array<struct<s:int,e:int>>")
    got = rows.select(chunking.bodies(F.col("text"), F.col("l"))).first()[0]
    assert [x["body"] for x in got] == [t[s:e] for s, e in spans]


@pytest.mark.parametrize("name", ["fixed_128_32", "fixed_10_0", "tokens_128_32", "tokens_7_3", "sentence", "semantic"])
def test_chunks_hold_their_text(spark, name):
    texts = [text(9000, i) for i in range(3)] + ["one", "..... ..... ....." * 40, "a" * 5000 + " b"]
    p = passages(spark, *texts)
    rows = chunking.chunk_text(chunking.chunker(name, 0.5)(p), p).orderBy("passage_id", "chunk_index").collect()
    assert {r["passage_id"] for r in rows} == set(range(len(texts)))
    for i, t in enumerate(texts):
        own = [r for r in rows if r["passage_id"] == i]
        assert [r["chunk_index"] for r in own] == list(range(len(own)))
        assert all(r["text"] == t[r["char_start"] : r["char_end"]] and r["text"].strip() == r["text"] for r in own)
        assert own[0]["char_start"] == 0 and own[-1]["char_end"] == len(t)
        if name.startswith("tokens"):
            assert all(r["char_start"] == 0 or t[r["char_start"] - 1] == " " for r in own) and all(r["char_end"] == len(t) or t[r["char_end"]] == " " for r in own)


@pytest.mark.parametrize("name", ["fixed_128_32", "tokens_128_32", "sentence", "semantic"])
def test_time_follows_the_length(spark, name):
    took = []
    for n in (40_000, 400_000, 1_600_000):
        p = passages(spark, text(n))
        began = time.perf_counter()
        chunking.chunk_text(chunking.chunker(name, 0.5)(p), p).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1] + 10, took  # in proportion: 4 times; a square would be 16 times


def test_questions_of_few_words(spark):
    p = passages(spark, "the quick brown fox", "a quick brown foxes", "quick", "xthe quick brown fo", "")
    asked = spark.createDataFrame([(1, "quick brown fox"), (2, "quick"), (3, "he quick brown fo"), (4, "brown fox"), (5, "the quick brown fox")], "query_id long, query_text string")
    got = sorted(map(tuple, tables.qrels(asked, p).collect()))
    want = sorted((q["query_id"], r["passage_id"]) for q in asked.collect() for r in p.collect() if q["query_text"] in r["text"])
    assert got == want


def test_token_offsets_in_one_pass(spark):
    """Not by the doubling of `running`, which goes over a list once for each bit of its length."""
    made = passages(spark, "a  b c", "", "x" * 9).select(chunking.token_offsets(F.col("text")).alias("o"))
    assert [r["o"] for r in made.collect()] == [[0, 1, 4, 6], [0], [0, 9]]
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
