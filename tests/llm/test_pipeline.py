"""The pipeline's stages, each on its own input, and the registered queries."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from cases import WORD, lower, no_docs, odd_docs, random_docs
from conftest import rows_of, rows_of_sql

from quillon.llm import mixing, queries, toxicity

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf, duck, name):
    assert rows_of(queries.queries()[name](spark, sf)) == rows_of_sql(duck, SQL[name])


def test_names():
    import __spark_entry__

    names = list(queries.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert {*names, "pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs(spark, extra=False))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns, name
            docs = out
        counts.append(out.count())
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] < counts[2]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).where("length < 1 or length > 2048").count() == 0


def test_run_cleans_up(spark, sf, tmp_path, monkeypatch):
    from quillon.llm import common

    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 1 and [p.name for p in (tmp_path / left[0]).iterdir()] == ["mixing"]


def test_empty_table_and_clashing_columns(spark, sf):
    empty = no_docs(spark).selectExpr("*", "1 as __id", "2 as __key", "3 as __size", "'x' as __text")
    some = odd_docs(spark).selectExpr("*", "doc_id as __id", "text as __key", "1 as __size", "'x' as __text")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        out = stage(spark, some, sf)
        assert out.count() > 0 and (name == "packing" or out.columns == some.columns), name


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, sf):
    """Each stage's rows from its own input, recomputed one row after the other."""
    docs = random_docs(spark, 120)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    best = {}
    for i, t in rows.items():
        best[norm(t)] = min(best.get(norm(t), (1, 0)), (-len(t), i))
    got = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()}
    assert got == {i for _, i in best.values()}
    ids, sets = sorted(rows), {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == {i for i in ids if root[i] == i}
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()) == Counter({i: n for i, n in taken.items() if n})
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(real, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r["doc_id"] for r in real.collect() if model.scores([r["text"] or ""])[0] < 0.5}
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, real, sf).collect()} == want
