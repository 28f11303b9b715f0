"""MinHash near-deduplication with fast similarity sketches, banding and exact verification.

Texts are lower-cased (A-Z) and cut into words; a text's set is its distinct 5-word shingles as 64-bit hashes. Two
texts are linked when the Jaccard similarity of their whole sets is at least `threshold` per cent, and a group is a
connected component of links.

1. *Sketch.* One pass computes each text's set, its size, a 128-bit key of its word sequence and a sketch of
   bands * rows coordinates (`textvec.sketches`). Texts of one key are one class with the smallest doc_id as its
   representative; only representatives go on, so copies are never paired.
2. *Band.* Representatives that agree in all rows of a band meet in a bucket; buckets with the same members count
   once. A bucket above `sketch_block` members is cut into blocks, each pair of which is a unit of work of its own, so
   that no task holds a large bucket. Within a unit, pairs whose sketches agree in fewer coordinates than six standard
   deviations below the threshold are left; the others are joined to clusters, of which only stars are returned.
3. *Verify.* The components of those stars are cut into blocks of `block` members in the same way; each unit holds the whole sets of its
   members and links every pair at or above the threshold, by the sizes of intersection and union. Pairs that its
   links have already connected need no proof. Again only stars are returned, and their components are the groups.

Words are hashed under a seed drawn for each run, eight bytes at a time and not as polynomials, so no texts are known to collide;
results do not depend on it but for the pairs that go unseen. A shingle is compared by its hash of 64 bits.

A pair at the threshold goes unseen when no band agrees: (1 - 0.85**5)**32 = 7e-9 at the defaults.

Null or blank texts have the empty set and are linked with nothing. Rows without doc_id are linked with nothing, have
no component_id and are kept. Rows repeated with one doc_id are one document. Very long texts are hashed whole, in blocks.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import secrets as random_bits
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec
from .common import discard, fresh, meet, parallelism, stored
from .graph import components

SKETCHED = "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"


def sketch_rows(batches: Iterator[pa.RecordBatch], k: int, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in textvec.slices(batch.column("text")):
            h, at = textvec.words(texts, seed=seed)
            k1, k2 = textvec.sequence_keys(h, at)
            value, begin = textvec.shingles(h, at, k)
            made = textvec.sketches(value, begin, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(texts)),
                    pa.array(np.diff(begin).astype(np.int64)),
                    pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)),
                    pa.array([x.tobytes() for x in made], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
            )


def set_rows(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in textvec.slices(batch.column("text")):
            value, begin = textvec.shingles(*textvec.words(texts, seed=seed), k)
            sets = [value[begin[i] : begin[i + 1]].tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(texts)), pa.array(sets, pa.binary())], names=["cid", "shingles"])


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def alike(sketch: np.ndarray, sizes: np.ndarray, least: int, threshold: int) -> Iterator[tuple[int, int]]:
    """Pairs i < j that agree in `least` coordinates and whose sizes allow the threshold, the most alike of a row first."""
    for i in range(len(sketch) - 1):
        same = (sketch[i + 1 :] == sketch[i]).sum(axis=1)
        low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        found = np.flatnonzero((same >= least) & (100 * low >= threshold * high))
        for j in found[np.argsort(-same[found], kind="stable")]:
            yield i, i + 1 + int(j)


def unit_links(ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray] | None, least: int, threshold: int) -> list[tuple[int, int]]:
    """(id, least id of its cluster) for the clusters of a unit; with `sets`, links are proved on them."""
    order = np.argsort(ids, kind="stable")
    ids, sizes, sketch = ids[order], sizes[order], sketch[order]
    forest = Forest(len(ids))
    for i, j in alike(sketch, sizes, least, threshold):
        if forest.root(i) == forest.root(j):
            continue
        if sets is not None:
            a, b = sets[order[i]], sets[order[j]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both < threshold * (len(a) + len(b) - both):
                continue
        forest.join(i, j)
    return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := forest.root(i)) != i]


def unit_rows(batches: Iterator[pa.RecordBatch], size: int, least: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """`unit_links` for each run of rows with one unit; rows come sorted by it. Only one unit is held."""

    def units() -> Iterator[list[tuple]]:
        unit, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, *row in zip(*columns, strict=True):
                if key != unit:
                    if len(rows) > 1:
                        yield rows
                    unit, rows = key, []
                rows.append(row)
        if len(rows) > 1:
            yield rows

    out: list[tuple[int, int]] = []
    for rows in units():
        ids = np.array([r[0] for r in rows], np.int64)
        sizes = np.array([r[1] for r in rows], np.int64)
        sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), size)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows] if len(rows[0]) > 3 else None
        out += unit_links(ids, sizes, sketch, sets, least, threshold)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def in_units(members: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Members (`group`, cid, `count` of the group) by unit: a group of at most `block` is one; a larger one is cut into
    blocks by a hash, and each pair of blocks is a unit, so that any two members meet in one."""
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks"))
    rows = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("cid", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("unit"))


def links(units: DataFrame, size: int, least: int, threshold: int) -> DataFrame:
    dealt = units.repartition(parallelism(units.sparkSession), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lambda it: unit_rows(it, size, least, threshold), "a long, b long")


def near_dedup(docs: DataFrame, threshold: int = 85, k: int = 5, bands: int = 32, rows: int = 5, sketch_block: int = 512, block: int = 128) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`. component_id is the smallest doc_id of the group."""
    size, seed = bands * rows, random_bits.randbits(63)
    p = threshold / 100
    agree = math.ceil(size * p - 6 * math.sqrt(size * p * (1 - p)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(texts.mapInArrow(lambda it: sketch_rows(it, k, size, seed), SKETCHED), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("n")), "classes")
    # A class may hold a third of all rows; its representative is found by its doc_id, which is no class's but its own.
    least = usable.join(classes.select("k1", "k2", F.col("cid").alias("doc_id")), ["k1", "k2", "doc_id"])
    reps = stored(least.select("k1", "k2", F.col("doc_id").alias("cid"), "n_shingles", "sketch").dropDuplicates(["k1", "k2", "cid"]), "representatives")
    n_reps, n_rows = reps.count(), sketched.count()

    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", 2 * rows * b + 1, 2 * rows)) for b in range(bands)])
    entries = reps.select("cid", F.explode(keys).alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("first"), F.bit_xor(F.xxhash64("cid")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "first", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.col("n").alias("rows"))
    met = in_units(meet(entries, buckets, ["bucket"], "rows", "cid", bands * n_reps), "bucket", "n", sketch_block)
    near = links(met.join(reps.select("cid", "n_shingles", "sketch"), "cid").select("unit", "cid", "n_shingles", "sketch"), size, agree, threshold)
    clusters = components(near)

    counts = clusters.groupBy("root").agg(F.count("*").alias("n"))
    members = stored(clusters.join(counts, "root").select("root", F.col("node").alias("cid"), "n"), "clusters")
    discard(clusters)
    found = texts.join(members.select(F.col("cid").alias("doc_id")).distinct(), "doc_id")
    sets = found.mapInArrow(lambda it: set_rows(it, k, seed), "cid long, shingles binary").join(reps.select("cid", "n_shingles", "sketch"), "cid")
    units = in_units(members, "root", "n", block).join(sets, "cid").select("unit", "cid", "n_shingles", "sketch", "shingles")
    groups = components(links(units, size, agree, threshold))

    discard(members)
    discard(reps)

    named = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select("k1", "k2", "n", F.coalesce("root", "cid").alias("component"))
    out = meet(sketched.select("doc_id", "n_shingles", "k1", "k2"), named, ["k1", "k2"], "n", "doc_id", n_rows, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup_keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay (the smallest doc_id of each group), with all their columns. Rows repeated with one
    doc_id are one document, so all rows of a doc_id stay or go together."""
    (ident,) = fresh(docs, "id")
    gone = near_dedup(docs, **options).where("not kept").select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(ident), "left_anti")
