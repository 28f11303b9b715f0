"""The segmented index against one built afresh, and what it leaves alone."""

import os

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quillon.operators import index, retrieve
from quillon.sources.segments import Conflict, Segments

UNITS = "chunk_id long, passage_id long, text string"


def units(spark, texts):
    return spark.createDataFrame([(i, i // 2, t) for i, t in texts.items()], UNITS)


def texts(n, seed, first=0):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(30)]
    return {first + i: " ".join(rng.choice(words, rng.integers(0, 12))) for i in range(n)}


def fresh(spark, now):
    rows = index.lengths(units(spark, now))
    postings = index.postings(rows).withColumn("bucket", index.bucket(F.col("term")))
    return index.Lexical(postings, postings.groupBy("term").agg(F.count("*").alias("df")), rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")))


def same(spark, got, now):
    want = fresh(spark, now)
    assert rows_of(got.lexical().postings.select(want.postings.columns)) == rows_of(want.postings)
    assert rows_of(got.lexical().df) == rows_of(want.df)
    assert rows_of(got.lexical().stats) == rows_of(want.stats)
    asked = spark.createDataFrame([(1, "word1 word2 word2"), (2, "word29 none"), (3, "")], "query_id long, query_text string")
    assert rows_of(retrieve.bm25_indexed(asked, got.lexical())) == rows_of(retrieve.bm25_indexed(asked, want))


def files(path, kind):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/{kind}") for f in names}


def test_changes_equal_a_fresh_build(spark, tmp_path):
    now = texts(60, 1)
    seg = Segments(spark, str(tmp_path)).apply(units(spark, now))
    same(spark, seg, now)
    before = files(tmp_path, "postings")
    new = texts(20, 2, first=50)  # ten edits, ten new units
    now |= new
    seg = seg.apply(units(spark, new))
    same(spark, seg, now)
    seg = seg.apply(units(spark, {3: None, 61: "word1 word1"}), spark.createDataFrame([(5,), (55,), (999,), (None,)], "chunk_id long"))
    now = {k: v for k, v in now.items() if k not in (5, 55)} | {3: "", 61: "word1 word1"}
    same(spark, seg, now)
    seg = seg.apply(deletes=spark.createDataFrame([(999,)], "chunk_id long"))
    same(spark, seg, now)
    after = files(tmp_path, "postings")
    assert len(seg.names) == 3 and all(after[f] == t for f, t in before.items())  # the first segment is not written again


def test_merges_keep_the_rows(spark, tmp_path):
    now, seg, sizes = {}, Segments(spark, str(tmp_path)), []
    for i in range(6):
        new = texts(8, i, first=6 * i)
        now |= new
        seg = seg.apply(units(spark, new)).merge(fan=2)
        sizes.append(len(seg.names))
    while seg.due(2):
        seg = seg.merge(2)
    same(spark, seg, now)
    assert max(sizes) <= 4 and len(seg.names) <= 3 and seg.merge(2) is seg
    old = Segments(spark, str(tmp_path), version=1)
    assert old.units().count() == 8
    gone = seg.vacuum()
    assert gone and f"{seg.version:08d}.json" not in gone
    same(spark, Segments(spark, str(tmp_path)), now)


def test_of_two_writers_one_wins(spark, tmp_path):
    seg = Segments(spark, str(tmp_path)).apply(units(spark, {1: "word1"}))
    other = Segments(spark, str(tmp_path))
    won = seg.apply(units(spark, {2: "word2"}))
    with pytest.raises(Conflict):
        other.apply(units(spark, {3: "word3"}))
    same(spark, Segments(spark, str(tmp_path)), {1: "word1", 2: "word2"})
    assert won.version == 2 and rows_of(other.units().select("chunk_id")) == [(1,)]


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "word1"), (1, 1, "word2"), (2, None, None)], UNITS)
    seg = Segments(spark, str(tmp_path)).apply(rows)
    assert rows_of(seg.units().select("chunk_id", "terms")) == [(1, ("word2",)), (2, ())]
    with pytest.raises(ValueError):
        seg.apply(spark.createDataFrame([(None, 1, "x")], UNITS))
    none = seg.apply(deletes=spark.createDataFrame([(1,), (2,)], "chunk_id long"))
    assert none.names == [] and none.lexical().postings.count() == 0 and none.lexical().stats.first()[0] == 0
    same(spark, none.apply(units(spark, {7: "word7"})), {7: "word7"})


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_a_change_leaves_nothing_beside_the_index(spark, tmp_path, monkeypatch, sent):
    """Tokens and dead units that a change writes go with its commit; tombstones filter the same, sent to the rows or not."""
    from quillon.sources import segments
    from quillon.sources.files import listed, shared_folder

    monkeypatch.setattr(segments, "SENT", sent)
    before = listed(spark, f"{shared_folder(spark)}/work")
    now = texts(30, 1)
    made = Segments(spark, f"file://{tmp_path}/{sent}").apply(units(spark, now))
    made = made.apply(units(spark, {3: "word1 new", 40: "word2"}), spark.createDataFrame([(5,), (7,), (99,)], "chunk_id long"))
    now = {i: t for i, t in (now | {3: "word1 new", 40: "word2"}).items() if i not in (5, 7)}
    asked = spark.createDataFrame([(1, "word1 word2 new"), (2, "word7")], "query_id long, query_text string")
    want = rows_of(retrieve.bm25_indexed(asked, fresh(spark, now)))
    names = ["term", "chunk_id", "passage_id", "dl", "n_terms", "tf", "bucket"]
    for state in (made, made.apply(units(spark, {41: ""}), spark.createDataFrame([(41,)], "chunk_id long")).apply(None, spark.createDataFrame([(41,)], "chunk_id long")).merge(2)):
        assert rows_of(retrieve.bm25_indexed(asked, state.lexical())) == want and rows_of(state.lexical().postings.select(names)) == rows_of(fresh(spark, now).postings.select(names))
    assert listed(spark, f"{shared_folder(spark)}/work") == before
