"""Lexical retrieval that does not read every posting: blocks of postings with the most a block can give, and bounds from them.

Units lie in *ranges* of units of about one length (a power of ``2**0.25``) and, within it, of a hash; a range has some
`per_range` units. The postings of a term in a range are a block, one row with arrays, whose header has the largest part
``tf / (tf + k1 (1 - b + b dl / avgdl))`` in it. Lengths are alike within a range, so a header is near what its postings give.

1. *Bounds.* The headers of a question's terms, weighted by idf and count, summed by range: no unit of the range scores more.
2. *Floor.* The ranges with the highest bounds, `first` of them, are scored; the k-th best score found is the question's floor.
3. *Rest.* Only ranges whose bound reaches the floor are scored; of all others no posting is read. For few questions a range is read if any of
   them needs it, and its postings go to their units once, for all questions. The k best of both are the result, which is that of `retrieve.bm25_indexed` to the last digit: bounds allow for the rounding of scores, and ties with the
   floor stay in.

Questions are a frame of any size; bounds, floors and blocks meet in joins, none is collected; what few questions ask is sent to the blocks. A question without known terms has no hits.
Empty units are in no range, but count for N and the mean length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..sources.files import written
from ..sources.tables import small
from . import index, retrieve
from .ranking import ranked, top_hits

SLACK = 2e-6  # scores are rounded to six digits


@dataclass
class Blocks:
    """headers (term, range, most, n), blocks (bucket, term, range, units array<struct<chunk_id, passage_id, part>>), and the
    document frequencies and numbers of the index they come from."""

    headers: DataFrame
    blocks: DataFrame
    df: DataFrame
    stats: DataFrame


def build(lexical: index.Lexical, k1: float = 1.2, b: float = 0.75, per_range: int = 64, asked: DataFrame | None = None) -> Blocks:
    """Blocks of all postings of an index, or of those of `asked` terms (term). Postings move once, to their ranges."""
    n = lexical.stats.first()["n"]
    postings = lexical.postings if asked is None else lexical.found(asked).join(asked.select("term").distinct(), "term", "left_semi")
    rows = postings.join(F.broadcast(lexical.stats), F.lit(True))  # one row
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    length = F.floor(F.log2(F.col("dl").cast("double")) * 4)
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // (8 * per_range))))  # some eight lengths are common
    rows = rows.select("bucket", "term", F.struct(length.cast("int").alias("length"), place.cast("int").alias("place")).alias("range"), "chunk_id", "passage_id", part.alias("part"))
    made = rows.repartition("range").groupBy("bucket", "term", "range").agg(F.collect_list(F.struct("chunk_id", "passage_id", "part")).alias("units"), F.max("part").alias("most"), F.count("*").alias("n"))
    made = written(made, "posting-blocks")
    headers = written(made.select("term", "range", "most", "n"), "posting-headers")
    return Blocks(headers, made.select("bucket", "term", "range", "units"), lexical.df, lexical.stats)


def weights(questions: DataFrame, blocks: Blocks, stop: list[str] | None = None) -> DataFrame:
    """(query_id, term, weight): idf times the term's count in the question."""
    asked = questions.select("query_id", F.explode(tx.index_tokens(F.col("query_text"), stop)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(blocks.df, "term").join(F.broadcast(blocks.stats), F.lit(True)).select("query_id", "term", "qf", idf.alias("idf"))  # one row


def scored(wanted: DataFrame, weighted: DataFrame, blocks: Blocks, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, chunk_id, passage_id, score) of the units of `wanted` (query_id, range)."""
    asked = sent(weighted.join(wanted, "query_id"))
    met = asked.join(blocks.blocks, ["term", "range"]).select("query_id", "qf", "idf", F.explode("units").alias("u"))
    sums = met.groupBy("query_id", F.col("u.chunk_id").alias("chunk_id"), F.col("u.passage_id").alias("passage_id"))
    return sums.agg(F.round(F.sum(F.col("qf") * (F.col("idf") * F.col("u.part"))), 6).alias("score")).where("score > 0")


def bounds(weighted: DataFrame, blocks: Blocks, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(query_id, range, bound)."""
    met = blocks.headers.join(sent(weighted), "term")
    return met.groupBy("query_id", "range").agg((F.sum(F.col("qf") * (F.col("idf") * F.col("most"))) + SLACK).alias("bound"))


def plan(questions: DataFrame, blocks: Blocks, k: int = 10, first: int = 8, stop: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, hits of the first ranges, the other ranges (query_id, range) that may hold a hit)."""
    weighted, sent = written(weights(questions, blocks, stop), "asked-terms"), retrieve.sender(questions)
    bound = written(bounds(weighted, blocks, sent), "bounds")
    begun = ranked(bound, ["query_id"], [F.desc("bound"), F.asc("range")], first, "nth").select("query_id", "range")
    early = written(top_hits(scored(begun, weighted, blocks, sent), k), "first-hits")
    floor = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = bound.join(begun, ["query_id", "range"], "left_anti").join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    return weighted, early, written(rest.select("query_id", "range"), "other-ranges")


def bm25(questions: DataFrame, blocks: Blocks, k: int = 10, first: int = 8, stop: list[str] | None = None) -> DataFrame:
    """Hits (query_id, chunk_id, passage_id, score, rank), equal to those over all postings."""
    weighted, early, rest = plan(questions, blocks, k, first, stop)
    if retrieve.few(questions):
        # What a question meets in a range that only others need is below its floor; what `early` has already keeps one row.
        ranges = written(rest.select("range").distinct(), "ranges")
        read = blocks.blocks.join(small(ranges), "range", "left_semi").select("term", F.explode("units").alias("u"))
        parts = read.join(F.broadcast(weighted.select("term", "idf").distinct()), "term").select("u.chunk_id", "u.passage_id", "term", (F.col("idf") * F.col("u.part")).alias("part"))
        every = early.drop("rank").unionByName(retrieve.summed(parts, weighted.select("query_id", "term", "qf"), k))
        return top_hits(every.groupBy("query_id", "chunk_id", "passage_id").agg(F.max("score").alias("score")), k)
    return top_hits(early.drop("rank").unionByName(scored(rest, weighted, blocks)), k)


def postings_read(questions: DataFrame, blocks: Blocks, k: int = 10, first: int = 8, stop: list[str] | None = None) -> DataFrame:
    """One row (n_all, n_read): postings of all questions' terms, question by question, and those in the ranges that are scored."""
    weighted, _, rest = plan(questions, blocks, k, first, stop)
    begun = ranked(bounds(weighted, blocks), ["query_id"], [F.desc("bound"), F.asc("range")], first, "nth").select("query_id", "range")
    met = weighted.join(blocks.headers, "term").select("query_id", "range", "n")
    read = met.join(begun.unionByName(rest), ["query_id", "range"], "left_semi")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all")).join(read.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_read")), F.lit(True))  # one row each

