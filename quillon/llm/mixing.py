"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a token budget by weight; a source's target stops at `max_repeats` times its size and the excess is
shared again among the others. A source's budget is then met in three steps, all of which see only its histogram of
exact token lengths, never its documents:

1. whole passes: every document as often as the size of the source goes into the target;
2. of what is left, the same share of the documents of each length, rounded down;
3. for the remaining tokens, the longest documents that fit until the rest is at most `dp_window` tokens, and then a
   bounded-knapsack subset sum over the documents still free of each length, whose best sum is the nearest to the
   rest from below.

How many documents of each length are taken is then fixed; which ones are, is decided by a seeded hash of doc_id. Of
one (source, length), which may hold a third of all rows, whole slices of the hash are taken and only the slice on
the edge is ranked, so no task sees a group whole.

Rows without doc_id go by a hash of their text instead. The driver holds a row for each source; up to `FEW_SOURCES` of
them are broadcast, more are joined by a shuffle, with the same result. The histogram of a source has at most as many rows as the source has distinct
lengths and is fitted in one task of its own. Null text has no tokens; documents without tokens are taken 0 times.
A null source is a source of its own, after all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, fresh, stored, text_or_empty

WEIGHTS = (5, 2, 1)
FEW_SOURCES = 100_000  # as many rows of a source each may be broadcast


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int = 3) -> list[float]:
    """Token targets of sources, which sum to all tokens: by weight, none above `max_repeats` times its size."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = sum(weights[i] for i in sorted(free))
        over = {i for i in free if left * weights[i] / share > max_repeats * sizes[i]}
        for i in over or free:
            out[i] = float(max_repeats * sizes[i]) if over else left * weights[i] / share
        free = free - over if over else set()
    return out


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most `counts`) to take so that their sum is the largest that `budget` holds.

    A bit of `reach` stands for a sum; a length's count is dealt into powers of two, so it costs O(log count) shifts.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable"):
        n, k = min(int(counts[i]), budget // int(lengths[i])), 1
        while n > 0:
            k = min(k, n)
            steps.append((i, k, reach))
            reach |= (reach << (k * int(lengths[i]))) & mask
            n, k = n - k, 2 * k
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_window: int) -> np.ndarray:
    """Documents to take of each length so that their tokens come near `budget` from below (steps 2 and 3)."""
    total = int((lengths * counts).sum())
    if budget >= total or not total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= dp_window:
            break
        n = min(int(counts[i] - take[i]), (rest - dp_window // 2) // int(lengths[i]))
        if n > 0:
            take[i] += n
            rest -= n * int(lengths[i])
    return take + subset_sum(lengths, counts - take, rest)


def identity() -> Column:
    """What a row goes by: its doc_id, or a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty(), F.lit("text")))


def sized(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), identity().alias("ident"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def quotas(sizes: DataFrame, weights: Sequence[float], max_repeats: int, dp_window: int) -> tuple[DataFrame, DataFrame]:
    """For each source (source, source_size, target, whole); for each (source, size) the number of documents to take once more."""
    spark = sizes.sparkSession
    lengths = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    found = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    aims = targets([r["t"] for r in found], [weights[i % len(weights)] for i in range(len(found))], max_repeats)
    rows = []
    for r, aim in zip(found, aims, strict=True):
        whole = min(int(aim // r["t"]), max_repeats) if r["t"] else 0
        rows.append((r["source"], int(r["t"]), float(aim), whole, min(round(aim - whole * r["t"]), r["t"]) if whole < max_repeats else 0))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, whole int, rest long")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        return pd.DataFrame({"source": group["source"], "size": lengths, "n": counts, "once_more": fit(lengths, counts, int(group["rest"].iloc[0]), dp_window)})

    if len(rows) <= FEW_SOURCES:
        plan = F.broadcast(plan)
    fitted = lengths.where("size > 0").join(plan, lengths["source"].eqNullSafe(plan["source"])).select(lengths["source"], "size", "n", "rest")
    return plan, fitted.groupBy("source").applyInPandas(one, "source string, size long, n long, once_more long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = 3, seed: int = 20, dp_window: int = 65536, slice_rows: int = 256, max_slices: int = 65536) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of `docs`.

    `weights` go to the sources by code point and repeat. `copies` is how often the mix has the document (at most
    `max_repeats`), `taken` = copies * size. `slice_rows`: rows of a slice of the hash, as long as `max_slices` allow.
    """
    spark = docs.sparkSession
    sizes = stored(sized(docs), "mix-sizes")
    plan, wanted = quotas(sizes, weights, max_repeats, dp_window)
    slices = min(max_slices, max(1, sizes.count() // slice_rows))
    draw = F.xxhash64(F.lit(seed), F.col("ident"))
    rows = sizes.withColumns({"draw": draw, "slice": F.pmod(draw, F.lit(slices)).cast("int")})
    steps = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.where("size > 0").groupBy("source", "size", "slice").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(steps), F.lit(0)))
    parts = parts.join(wanted.select(F.col("source").alias("s"), F.col("size").alias("z"), "once_more"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    parts = parts.select("s", "z", F.col("slice").alias("p"), (F.col("once_more") - F.col("before")).alias("upto")).where("upto > 0")
    nth = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "ident"))
    met = rows.withColumn("nth", nth).join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("p")), "left")
    plan = plan.select(F.col("source").alias("from"), "source_size", "target", "whole")
    met = met.join(plan, F.col("source").eqNullSafe(F.col("from")))
    copies: Column = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("nth") <= F.col("upto"), 1).otherwise(0)).otherwise(0)
    return met.select("doc_id", "ident", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix has them, with all their columns. Rows repeated with one doc_id and size
    share evenly what the mix takes of them."""
    ident, size, copies, n, nth, times = work = fresh(docs, "ident", "size", "copies", "rows", "nth", "times")
    taken = mix(docs, **options).where("copies > 0").groupBy(F.col("ident").alias(ident), F.col("size").alias(size)).agg(F.sum("copies").alias(copies), F.count("*").alias(n))
    rows = docs.withColumns({ident: identity(), size: F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")})
    number = F.row_number().over(Window.partitionBy(ident, size).orderBy(ident))
    share = F.floor(F.col(copies) / F.col(n)) + F.when(F.col(nth) <= F.col(copies) % F.col(n), 1).otherwise(0)
    met = rows.join(taken, [ident, size]).withColumn(nth, number).withColumn(times, share.cast("int")).where(F.col(times) > 0)
    return met.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(*work)
