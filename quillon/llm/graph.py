"""Connected components of an edge table, for the deduplication of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, meet, stored


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node of its component.

    Alternates large-star and small-star (Kiveris and others, 2014): every round hooks nodes to the least neighbour,
    in two joins on a node, until only stars are left; the rounds grow with the logarithm of the size of a component.
    The neighbours of a node, which may be very many in the middle of a star, meet its least one in parts by their number.
    Each round is written to the shared folder. Nothing is collected but a row count and a checksum.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen, size = None, e.count()
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        large = meet(both, least, ["x"], "n", "y", 2 * size).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, low, ["u"], "n", "v", 2 * size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        discard(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        size = now[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
