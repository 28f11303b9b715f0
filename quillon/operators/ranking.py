"""Ranks in a total order, fusion of ranked lists, and duplicates by passage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60


def ranked(df: DataFrame, by: list[str], order: list[Column], keep: int | None = None, name: str = "rank") -> DataFrame:
    """`name` = 1, 2, ... within `by`; `order` must be total. With `keep`, Spark cuts each partition before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= keep) if keep else out


def top_hits(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return ranked(scored, list(by), [F.desc("score"), F.asc("passage_id"), F.asc("chunk_id")], k)


def rrf(lists: dict[str, DataFrame], k: int | None = None, by: tuple[str, ...] = ("query_id",), constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of hit lists (by, chunk_id, passage_id, rank).

    score = sum of 1 / (constant + rank); ties go to the list named first, then to the better rank there.
    `ranks` maps a list's name to the rank in it.
    """
    named = [df.select(*by, "chunk_id", "passage_id", "rank", F.lit(name).alias("list"), F.lit(i).alias("nth")) for i, (name, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, named)
    merged = every.groupBy(*by, "chunk_id", "passage_id").agg(
        F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("nth", "rank")).alias("first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rank")))).alias("ranks"),
    )
    return ranked(merged, list(by), [F.desc("score"), F.asc("first.nth"), F.asc("first.rank"), F.asc("chunk_id")], k).drop("first")


def first_per_passage(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best-ranked hit of each passage, ranked anew."""
    best = ranked(hits, [*by, "passage_id"], [F.asc("rank"), F.asc("chunk_id")], 1, "__nth").drop("__nth")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "chunk_id")))
