from cases import no_docs, odd_docs, random_docs
from pyspark.sql import functions as F

from quillon.llm import token_counts as tc


def labels(spark, *ids):
    return spark.createDataFrame([(i, 0, 0) for i in ids], "doc_id long, quality int, toxic int")


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def recount(docs, gone):
    import re

    want = {}
    for r in docs.collect():
        if r["doc_id"] in gone:
            continue
        plain = re.sub(r"[^\x20\x09-\x0D]+@[^\x20\x09-\x0D]+", "", r["text"] or "")
        n = {"words-1": len(re.findall(r"[^\x20\x09-\x0D]+", plain)), "pieces-1": len(re.findall(r"[^\W\d_]+|\d|[^\s]", plain))}
        for v, k in n.items():
            d, t = want.get((r["source"], r["lang"], v), (0, 0))
            want[r["source"], r["lang"], v] = (d + 1, t + k)
    return want


def test_corpus(spark, tmp_path):
    for make in (odd_docs, random_docs):
        docs = make(spark)
        rollup = tc.corpus_rollup(docs, labels(spark, 1, 9, 13), f"file://{tmp_path}/{make.__name__}")
        assert totals(rollup) == recount(docs, {1, 9, 13})
        assert rollup.committed() == ["load", "retire", "revise"]


def test_batches_commit_once(spark, tmp_path):
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, "en", "v1", None)], "source string, lang string, tokenizer_version string, n long")
    assert rollup.totals().count() == 0
    assert rollup.commit("one", rows.withColumns(tc.inserted(F.col("n"))))
    assert not rollup.commit("one", rows.withColumns(tc.inserted(F.col("n"))))
    assert totals(rollup) == {("a", "en", "v1"): (2, 12), (None, "en", "v1"): (1, 0)}
    assert rollup.commit("two", rows.where("n = 5").withColumns(tc.revised(F.col("n"), F.lit(9))))
    assert rollup.commit("three", rows.where("n = 7").withColumns(tc.deleted(F.col("n"))))
    assert totals(rollup)["a", "en", "v1"] == (1, 9)
    rows.withColumns(tc.inserted(F.col("n"))).selectExpr("source", "lang", "tokenizer_version", "cast(docs as long) docs", "tokens").write.parquet(f"{tmp_path}/r/attempts/four-x")
    assert totals(rollup)["a", "en", "v1"] == (1, 9)  # written, but not committed
    assert rollup.commit("four", rows.limit(0).withColumns(tc.inserted(F.col("n"))))
    assert totals(rollup)["a", "en", "v1"] == (1, 9)


def test_two_runners_of_one_batch(spark, tmp_path, monkeypatch):
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, tokenizer_version string, n long").withColumns(tc.inserted(F.col("n")))
    assert rollup.commit("one", rows)
    late = tc.Rollup(spark, rollup.path)
    monkeypatch.setattr(late, "committed", lambda: [])  # it looked before the other committed
    assert not late.commit("one", rows.withColumn("tokens", F.lit(1000)))
    assert totals(rollup) == {("a", "en", "v1"): (1, 5)} and rollup._names("attempts") == []


def test_snapshots(spark, tmp_path):
    rollup = tc.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, tokenizer_version string, n long")
    assert rollup.commit("b", rows.withColumns(tc.inserted(F.col("n")))) and rollup.compact() and not rollup.compact()
    assert rollup.commit("a", rows.withColumns(tc.inserted(F.col("n"))))
    assert totals(rollup)["a", "en", "v1"] == (2, 10)
    assert rollup.compact() and totals(rollup)["a", "en", "v1"] == (2, 10)
    assert not rollup.commit("a", rows.withColumns(tc.inserted(F.col("n"))))
    for _ in range(3):
        assert rollup.commit(f"gone{_}", rows.withColumns(tc.deleted(F.col("n"))))
    assert totals(rollup)["a", "en", "v1"] == (-1, -5)  # deleted once more than inserted


def test_empty(spark, tmp_path):
    assert totals(tc.corpus_rollup(no_docs(spark), labels(spark), f"file://{tmp_path}/e")) == {}
