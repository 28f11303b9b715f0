"""The approximate index against exact search, and exact search in blocks against one matrix."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from quillon.operators import ann, retrieve

VECTORS = "chunk_id long, passage_id long, embedding array<float>"


def made(spark, n=1500, dim=16, seed=3, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    rows = centres[rng.integers(20, size=n)] + 0.4 * rng.normal(size=(n, dim))
    rows[:hot] = rows[0]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return spark.createDataFrame([(i, i // 2, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)], VECTORS)


def asked(vectors, step=10):
    return vectors.where(F.col("chunk_id") % step == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@pytest.mark.parametrize("hot, block, part", [(0, 4096, 8192), (500, 16, 64)])
def test_all_lists_are_exact(spark, hot, block, part):
    vectors = made(spark, hot=hot)
    index = ann.build(vectors, lists=12)
    assert index.lists.count() == 1500 and index.sizes.agg(F.sum("size")).first()[0] == 1500
    got = ann.search(asked(vectors), index, probes=12, block=block, part=part)
    assert rows_of(got) == rows_of(retrieve.dense(asked(vectors), vectors))


def test_recall_and_lists_read(spark):
    vectors = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("passage_id"), "embedding")
    index = ann.build(vectors)
    lists = len(index.centroids)
    assert 40 <= lists <= 50
    queries = asked(vectors, 100)
    exact = retrieve.dense(queries, vectors)
    probes = ann.probes_for(index)
    means = [ann.recall(ann.search(queries, index, probes=p), exact).agg(F.avg("recall")).first()[0] for p in (2, probes, lists)]
    assert means[0] < means[1] <= means[2] == 1.0 and means[1] >= 0.9 and probes < lists, (probes, means)


def test_fewer_probes_where_vectors_cluster(spark):
    vectors = made(spark, 3000)
    index = ann.build(vectors, lists=20)
    probes = ann.probes_for(index)
    exact = retrieve.dense(asked(vectors), vectors)
    assert probes <= 10 and ann.recall(ann.search(asked(vectors), index, probes=probes), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_any_number_of_questions(spark):
    vectors = made(spark, 400)
    whole = rows_of(retrieve.dense(asked(vectors, 2), vectors))
    assert rows_of(retrieve.dense(asked(vectors, 2), vectors, most=30)) == whole
    parts = retrieve.in_blocks(asked(vectors, 2), vectors, 10, 30, part=64)
    assert rows_of(retrieve.top_hits(parts, 10)) == whole
    plan = retrieve.dense(asked(vectors, 2), vectors, most=30)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nulls_and_empty_tables(spark):
    vectors = made(spark, 50).unionByName(spark.createDataFrame([(1000, 1000, None)], VECTORS))
    index = ann.build(vectors, lists=4)
    assert index.lists.count() == 50
    none = spark.createDataFrame([], "query_id long, query_vec array<float>")
    assert ann.search(none, index).collect() == []
    empty = ann.build(spark.createDataFrame([], VECTORS))
    assert len(empty.centroids) == 0 and ann.search(asked(vectors), empty).collect() == []
    one = asked(vectors).unionByName(spark.createDataFrame([(7, None)], "query_id long, query_vec array<float>"))
    assert {r["query_id"] for r in ann.search(one, index).collect()} == {0, 10, 20, 30, 40}


def test_probes_are_handed_on_in_parts():
    """Each question's vector is repeated for each list it probes: never for a whole batch at once."""
    rng = np.random.default_rng(4)
    centroids = ann.unit(rng.normal(size=(40, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(list(rng.normal(size=(500, 8)).astype(np.float32)), pa.list_(pa.float32()))], names=["query_id", "query_vec"])
    parts = list(ann.probed(batch, centroids, 30, most=100))
    assert len(parts) == 167 and max(p.num_rows for p in parts) <= 100
    assert pa.Table.from_batches(parts) == pa.Table.from_batches(list(ann.probed(batch, centroids, 30, most=10**9))).cast(parts[0].schema)
    assert max(p.num_rows for p in ann.probed(batch, centroids, 30, most=7)) == 30
