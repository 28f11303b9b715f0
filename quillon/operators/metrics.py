"""Retrieval metrics over ranked hits and gold passages, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .ranking import first_per_passage

KS = (1, 3, 5, 10, 20)


def question_metrics(hits: DataFrame, gold: DataFrame, asked: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """A row for each of `asked` (by): n_gold, n_passages, mrr, first_gold_rank and recall, precision, hit, ndcg at each k.

    Hits are collapsed to passages in rank order first. Without gold passages only the two counts are set; precision
    is over k, whatever was retrieved.
    """
    by = list(by)
    flat = first_per_passage(hits, tuple(by)).select(*by, "passage_id", "rank")
    marked = flat.join(gold.select("query_id", "passage_id").distinct().withColumn("gold", F.lit(True)), ["query_id", "passage_id"], "left")
    good = F.coalesce("gold", F.lit(False))
    aggs = [F.count("*").alias("n_passages"), F.min(F.when(good, F.col("rank"))).alias("first_gold_rank")]
    for k in ks:
        aggs.append(F.sum(F.when(good & (F.col("rank") <= k), 1).otherwise(0)).alias(f"h{k}"))
        aggs.append(F.sum(F.when(good & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}"))
    n_gold = gold.select("query_id", "passage_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    rows = asked.join(n_gold, "query_id", "left").join(marked.groupBy(*by).agg(*aggs), by, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ["n_gold", "n_passages", *(f"{x}{k}" for k in ks for x in "hd")]})
    some = F.col("n_gold") > 0
    out = [F.when(some, F.coalesce(1 / F.col("first_gold_rank"), F.lit(0.0))).alias("mrr"), F.when(some, F.col("first_gold_rank")).alias("first_gold_rank")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_gold", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out.append(F.when(some, F.round(F.col(f"h{k}") / F.col("n_gold"), 6)).alias(f"recall_{k}"))
        out.append(F.when(some, F.round(F.col(f"h{k}") / k, 6)).alias(f"precision_{k}"))
        out.append(F.when(some, F.when(F.col(f"h{k}") > 0, 1.0).otherwise(0.0)).alias(f"hit_{k}"))
        out.append(F.when(some, F.round(F.col(f"d{k}") / ideal, 6)).alias(f"ndcg_{k}"))
    return rows.select(*by, "n_gold", "n_passages", *out)


def means(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean of each metric over the questions that have it, and their number."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def pivoted(summary: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    return summary.groupBy(rows).pivot(columns, names).agg(F.round(F.avg(value), 6))


def scaled(summary: DataFrame, value: str, inverted: bool = False, name: str = "scale") -> DataFrame:
    """`name`: a value between the least (0) and the largest (1); one half if all are the same. `summary` is a small table."""
    ends = summary.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    scale = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise(1 - at if inverted else at)
    return summary.crossJoin(F.broadcast(ends)).withColumn(name, F.round(scale, 6)).drop("lo", "hi")  # ends is one row


def delta(summary: DataFrame, base: str, other: str, value: str, on: list[str]) -> DataFrame:
    """`value` under two layers side by side, and the gain."""
    a = summary.where(F.col("layer") == base).select(*on, F.col(value).alias("base"))
    b = summary.where(F.col("layer") == other).select(*on, F.col(value).alias("other"))
    return a.join(b, on).withColumn("gain", F.round(F.col("other") - F.col("base"), 6))


def id_context(hits: DataFrame, gold: DataFrame, asked: DataFrame) -> DataFrame:
    """Set-based precision and recall of the distinct retrieved ids."""
    found = hits.groupBy("query_id").agg(F.collect_set("passage_id").alias("got"))
    right = gold.groupBy("query_id").agg(F.collect_set("passage_id").alias("gold"))
    none = F.array().cast("array<long>")
    rows = asked.select("query_id").join(found, "query_id", "left").join(right, "query_id", "left").withColumns({"got": F.coalesce("got", none), "gold": F.coalesce("gold", none)})
    both = F.size(F.array_intersect("got", "gold"))
    return rows.select("query_id", F.round(both / F.greatest(F.size("got"), F.lit(1)), 6).alias("id_precision"), F.when(F.size("gold") > 0, F.round(both / F.size("gold"), 6)).alias("id_recall"))


def running_gain(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Cumulative discounted gain along each question's ranks."""
    marked = hits.join(gold.withColumn("gold", F.lit(1)), ["query_id", "passage_id"], "left")
    gain = F.when(F.col("gold") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("query_id", "rank", F.round(F.sum(gain).over(so_far), 6).alias("dcg"))


def token_f1(answer: Column, gold: Column) -> Column:
    """Harmonic mean of the shares of either text's distinct tokens that the other has: a judge that needs no model, a proxy
    and not a judgement of facts."""
    a, b = F.array_distinct(tx.index_tokens(answer)), F.array_distinct(tx.index_tokens(gold))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(F.round(2 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1)), 6))


def token_support(answer: Column, context: Column) -> Column:
    """Share of an answer's distinct tokens that its context has: the proxy of faithfulness. None without tokens."""
    a = F.array_distinct(tx.index_tokens(answer))
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, F.array_distinct(tx.index_tokens(context)))) / F.size(a), 6))
