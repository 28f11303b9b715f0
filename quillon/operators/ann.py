"""Approximate nearest neighbours: inverted lists over trained centroids, stored as a table, with probing.

1. *Centroids.* Spherical k-means over a sample of at most `sample` vectors (by a seeded hash of chunk_id), in Spark: each round
   sends the centroids (at most `MOST_LISTS`) to all tasks, which return sums by centroid. The sample is only for the
   centroids; every vector is indexed.
2. *Lists.* Each vector goes to its nearest centroid. The lists are written in ranges of (list, chunk_id), so a file holds
   a few lists, a list that holds a third of all vectors lies in several files, and its rows are dealt to `part` vectors each.
3. *Probing.* A question looks at the `probes` lists whose centroids are nearest. It meets the parts of those lists in
   blocks of at most `block` questions and `part` vectors, as matrix products; each block hands on its own k best.
   No question meets a list that it does not probe, and no task more than a block, whatever the number of either. `probes_for`
   measures how many probes a recall takes.

With as many probes as lists the result is that of `retrieve.dense`. Vectors must be unit vectors of one length; null vectors
are not indexed and not asked. Ties of centroids go to the lower one, ties of hits to the lower passage_id, then chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.files import written
from .ranking import top_hits
from .retrieve import SCORED, dense, flat, scored_block

MOST_LISTS = 4096


@dataclass
class Inverted:
    """Centroids (lists x dimensions), the vectors by list (list, chunk_id, passage_id, embedding) and the sizes of the lists."""

    centroids: np.ndarray
    lists: DataFrame
    sizes: DataFrame


def nearest(batch: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first."""
    near = np.empty((len(batch), n), np.int64)
    for lo in range(0, len(batch), 1024):
        score = np.round(batch[lo : lo + 1024] @ centroids.T, 9)
        near[lo : lo + 1024] = np.argsort(-score, axis=1, kind="stable")[:, :n]
    return near


def probed(batch: pa.RecordBatch, centroids: np.ndarray, probes: int, most: int = 16_384) -> Iterator[pa.RecordBatch]:
    """(list, query_id, query_vec): a row for each question of `batch` and list that it probes. A question's vector is repeated for each
    of its lists, so questions are taken in parts that give at most `most` rows (one question, if it probes more lists)."""
    step = max(1, most // probes)
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        near = nearest(flat(part.column("query_vec")).reshape(part.num_rows, -1), centroids, probes)
        of = pa.array(np.repeat(np.arange(part.num_rows), probes))
        yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), part.column("query_id").take(of), part.column("query_vec").take(of)], names=["list", "query_id", "query_vec"])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def trained(vectors_of: DataFrame, lists: int, sample: int = 65_536, rounds: int = 8, seed: int = 20) -> np.ndarray:
    """Centroids by spherical k-means over at most `sample` vectors; those that lose all vectors keep their place."""
    spark = vectors_of.sparkSession
    chosen = written(vectors_of.where("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(sample).select("embedding").repartition(spark.sparkContext.defaultParallelism), "ann-sample")
    first = flat(chosen.limit(lists).toArrow()["embedding"].combine_chunks())
    centroids = unit(first.reshape(min(lists, chosen.limit(lists).count()), -1)) if len(first) else np.zeros((0, 0))
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(sent.value)
            for batch in batches:
                if batch.num_rows:
                    own = flat(batch.column("embedding")).reshape(batch.num_rows, -1)
                    np.add.at(sums, nearest(own, sent.value)[:, 0], own)
            seen = np.flatnonzero(np.abs(sums).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(list(sums[seen]), pa.list_(pa.float64()))], names=["list", "sums"])

        made = chosen.mapInArrow(run, "list long, sums array<double>").toArrow()  # lists x tasks rows at most
        sums = np.zeros_like(centroids)
        if len(made):
            np.add.at(sums, made["list"].to_numpy(), flat(made["sums"].combine_chunks()).reshape(len(made), -1))
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids[moved] = unit(sums[moved])
    return centroids


def build(vectors_of: DataFrame, lists: int | None = None, sample: int = 65_536, rounds: int = 8, seed: int = 20) -> Inverted:
    """The inverted lists of all of `vectors_of` (chunk_id, passage_id, embedding); by default about the root of their number."""
    spark = vectors_of.sparkSession
    n = vectors_of.count()
    centroids = trained(vectors_of, min(MOST_LISTS, lists or max(1, round(n**0.5))), sample, rounds, seed)
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(flat(batch.column("embedding")).reshape(batch.num_rows, -1), sent.value)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *(batch.column(c) for c in ("chunk_id", "passage_id", "embedding"))], names=["list", "chunk_id", "passage_id", "embedding"])

    rows = vectors_of.where("embedding is not null").select("chunk_id", "passage_id", F.col("embedding").cast("array<float>").alias("embedding"))
    placed = written(rows.mapInArrow(run, "list int, chunk_id long, passage_id long, embedding array<float>").repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id"), "ann-lists")
    return Inverted(centroids, placed, placed.groupBy("list").agg(F.count("*").alias("size")))


def search(queries: DataFrame, index: Inverted, k: int = 10, probes: int = 16, block: int = 4096, part: int = 8192) -> DataFrame:
    """Hits (query_id, chunk_id, passage_id, score, rank) of `queries` (query_id, query_vec), about the k nearest."""
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids)
    probes = min(probes, len(index.centroids))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and probes:
                yield from probed(batch, sent.value, probes)

    asked = queries.where("query_vec is not null").select("query_id", F.col("query_vec").cast("array<float>").alias("query_vec")).mapInArrow(probe, "list int, query_id long, query_vec array<float>")
    asked = written(asked, "ann-probes")
    # A row for each list, so at most MOST_LISTS: how many blocks of questions and parts of vectors it has.
    plan = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).join(index.sizes, "list").select("list", "blocks", F.ceil(F.col("size") / F.lit(part)).cast("int").alias("parts"))
    plan = F.broadcast(plan)
    left = asked.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = index.lists.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")))

    def run(questions: pa.Table, found: pa.Table) -> pa.Table:
        ids = questions["query_id"].to_numpy()
        made = []
        if len(ids) and len(found):
            matrix = flat(questions["query_vec"].combine_chunks()).reshape(len(ids), -1)
            made = [b for batch in found.combine_chunks().to_batches(4096) for b in scored_block(ids, matrix, batch, k)]
        return pa.Table.from_batches(made, schema=pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("passage_id", pa.int64()), ("score", pa.float64())]))

    keys = ["list", "block", "part"]
    columns = ["query_id", "query_vec"], ["chunk_id", "passage_id", "embedding"]
    scored = left.select(*keys, *columns[0]).groupBy(*keys).cogroup(right.select(*keys, *columns[1]).groupBy(*keys)).applyInArrow(run, SCORED)
    return top_hits(scored, k)


def probes_for(index: Inverted, target: float = 0.95, k: int = 10, sample: int = 256, seed: int = 21) -> int:
    """The fewest probes with which `target` of the k nearest are found, measured on at most `sample` indexed vectors as
    questions: each of their exact hits lies in a list, whose place among the question's nearest centroids is what it takes."""
    chosen = written(index.lists.orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec")), "ann-questions")
    exact = dense(chosen, index.lists, k).select("query_id", "chunk_id")
    rows = exact.join(index.lists.select("chunk_id", "list"), "chunk_id").join(chosen, "query_id").select("list", "query_vec").toArrow()  # k * sample rows
    if not len(rows):
        return 1
    order = nearest(flat(rows["query_vec"].combine_chunks()).reshape(len(rows), -1), index.centroids, len(index.centroids))
    place = np.argmax(order == rows["list"].to_numpy()[:, None], axis=1) + 1
    return int(np.sort(place)[max(0, int(np.ceil(target * len(place))) - 1)])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a question's exact hits that were found."""
    right = exact.select("query_id", "chunk_id")
    both = right.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
