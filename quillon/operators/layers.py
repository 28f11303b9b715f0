"""Layers around retrieval: several queries for a question, reranking, context, answers, citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as tx
from ..sources.tables import small
from .chunking import SLOTS
from .ranking import first_per_passage, ranked


def feedback_queries(questions: DataFrame, hits_text: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, nth, query_text): the question, and for each of its best `most` hits the question with that hit's first
    sentence: query expansion without a language model. Any frame of these columns may take its place."""
    own = questions.select("query_id", F.lit(0).alias("nth"), "query_text")
    more = hits_text.where(F.col("rank") <= most).join(questions, "query_id")
    return own.unionByName(more.select("query_id", F.col("rank").alias("nth"), F.concat_ws(" ", "query_text", F.element_at(tx.sentences(F.col("text")), 1)).alias("query_text")))


def relevance_model(questions: DataFrame, hits_text: DataFrame, most: int = 10, mix: float = 0.5, stop: list[str] | None = None) -> DataFrame:
    """(query_id, term, weight, nth): the `most` heaviest terms of a relevance model of the first hits (query_id, chunk_id, score, text).

    A hit counts by its share of the scores, a term by its share of the hit's tokens; the question's own shares are mixed in by
    `mix`. Questions without hits have their own terms alone, at `mix`. Ties go to the term first in order.
    """
    total = F.sum("score").over(Window.partitionBy("query_id"))
    hits = hits_text.select("query_id", "chunk_id", (F.col("score") / total).alias("share"), tx.index_tokens(F.col("text"), stop).alias("tokens"))
    theirs = hits.select("query_id", "share", F.size("tokens").alias("size"), F.explode("tokens").alias("term")).select("query_id", "term", ((1 - mix) * F.col("share") / F.col("size")).alias("weight"))
    asked = questions.select("query_id", tx.index_tokens(F.col("query_text"), stop).alias("tokens"))
    own = asked.select("query_id", F.size("tokens").alias("size"), F.explode("tokens").alias("term")).select("query_id", "term", (F.lit(mix) / F.col("size")).alias("weight"))
    sums = theirs.unionByName(own).groupBy("query_id", "term").agg(F.round(F.sum("weight"), 9).alias("weight"))
    return ranked(sums, ["query_id"], [F.desc("weight"), F.asc("term")], most, "nth")


def hypothetical(questions: DataFrame, hits_text: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, nth, query_text): the question, and a text of the heaviest terms of its relevance model, which stands for the passage that
    a language model would write."""
    terms = relevance_model(questions, hits_text, most)
    made = terms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]), " ").alias("query_text"))
    return questions.select("query_id", F.lit(0).alias("nth"), "query_text").unionByName(made.select("query_id", F.lit(1).alias("nth"), "query_text"))


def clauses(questions: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, nth, query_text): the question, and its clauses of two index tokens at least where there are two or more of
    them, `most` at most."""
    parts = F.filter(F.transform(F.split("query_text", tx.CLAUSE_BREAK), lambda p: F.trim(p)), lambda p: F.size(tx.index_tokens(p)) >= 2)
    rows = questions.select("query_id", "query_text", parts.alias("parts"))
    some = F.when(F.size("parts") >= 2, F.slice("parts", 1, most)).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", F.posexplode(F.concat(F.array("query_text"), some)).alias("nth", "query_text"))


def listed_queries(questions: DataFrame, generated: DataFrame, mode: str) -> DataFrame:
    """(query_id, nth, query_text) from a model's raw replies (query_id, reply), a JSON list in each.

    mode ``multi``: the question and three at most; ``decompose``: the question and four at most, none of which is the
    question in other case; ``hyde``: the question and the reply as it is.
    """
    most = {"multi": 3, "decompose": 4, "hyde": 1}[mode]
    joined = questions.join(generated, "query_id", "left")
    reply = F.coalesce("reply", F.lit(""))
    items = F.array(reply) if mode == "hyde" else tx.json_list(reply)
    if mode == "decompose":
        items = F.filter(items, lambda q: F.lower(F.trim(q)) != F.lower(F.trim(F.col("query_text"))))
    every = F.concat(F.array("query_text"), F.slice(items, 1, most))
    return joined.select("query_id", F.posexplode(every).alias("nth", "query_text"))


def multi_query(queries: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], k: int) -> DataFrame:
    """Retrieve 2k hits for each of a question's queries (query_id, nth, query_text) and fuse them."""
    slots = 1000
    flat = queries.select((F.col("query_id") * slots + F.col("nth")).alias("query_id"), "query_text")
    hits = retrieve(flat, 2 * k).withColumn("nth", F.pmod("query_id", F.lit(slots))).withColumn("query_id", F.floor(F.col("query_id") / slots).cast("long"))
    merged = hits.groupBy("query_id", "chunk_id", "passage_id").agg(F.round(F.sum(1 / (F.lit(60) + F.col("rank"))), 9).alias("score"), F.min(F.struct("nth", "rank")).alias("first"))
    return ranked(merged, ["query_id"], [F.desc("score"), F.asc("first.nth"), F.asc("first.rank"), F.asc("chunk_id")], k).drop("first")


def lexical_score(question: Column, text: Column) -> Column:
    """The default reranker: share of the question's distinct index tokens that the text has, times the share of the
    text's distinct tokens that the question has, square-rooted. A model's UDF (question, text) -> double may take its place."""
    a, b = F.array_distinct(tx.index_tokens(question)), F.array_distinct(tx.index_tokens(text))
    n = F.greatest(F.size(a) * F.size(b), F.lit(1)).cast("double")
    return F.round(F.size(F.array_intersect(a, b)) / F.sqrt(n), 6)


def rerank(hits_text: DataFrame, questions: DataFrame, k: int = 10, score: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The k best hits by `score` of question and chunk text; ties keep their order. `before_rank` and `before_score` stay."""
    rows = hits_text.join(small(questions.select("query_id", "query_text")), "query_id")
    rows = rows.withColumnsRenamed({"score": "before_score", "rank": "before_rank"}).withColumn("score", score(F.col("query_text"), F.col("text")))
    return ranked(rows, ["query_id"], [F.desc("score"), F.asc("before_rank")], k).drop("query_text")


def expand_window(hits: DataFrame, chunks: DataFrame, passages: DataFrame, window: int = 1) -> DataFrame:
    """Hits with the span of their chunk and its neighbours, and its text: an equi join on passage and index."""
    near = hits.withColumn("at", F.pmod("chunk_id", F.lit(SLOTS)).cast("int"))  # a chunk's id holds its index
    near = near.withColumn("chunk_index", F.explode(F.sequence(F.col("at") - window, F.col("at") + window)))
    spans = near.join(chunks.select("passage_id", "chunk_index", "char_start", "char_end"), ["passage_id", "chunk_index"])
    wide = spans.groupBy("query_id", "chunk_id", "passage_id", "score", "rank").agg(F.min("char_start").alias("context_start"), F.max("char_end").alias("context_end"))
    body = F.substr(F.col("text"), F.col("context_start") + 1, F.col("context_end") - F.col("context_start"))
    return wide.join(passages.select("passage_id", "text"), "passage_id").withColumn("context_text", body).drop("text")


def expand_parent(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """One hit for each passage, with the whole passage as its context."""
    rows = first_per_passage(hits).join(passages.select("passage_id", "text"), "passage_id", "left")
    text = F.coalesce("text", F.lit(""))
    return rows.withColumns({"context_start": F.lit(0), "context_end": F.length(text), "context_text": text}).drop("text")


def format_context(hits_text: DataFrame) -> DataFrame:
    """(query_id, context): numbered passages, a blank line between."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (ID "), F.col("passage_id").cast("string"), F.lit(") "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits_text.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"))


def extractive_answers(hits_text: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer): the first sentence of each of the best hits, with its mark: answers without a language model."""
    part = F.concat(F.element_at(tx.sentences(F.col("text")), 1), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits_text.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("answer"))


def citations(answers: DataFrame, hits: DataFrame, link: str = "https://pubmed.ncbi.nlm.nih.gov/%s/") -> DataFrame:
    """(query_id, n, passage_id, url) for each mark [n] of an answer that is a hit's rank."""
    marks = answers.select("query_id", F.explode(tx.cited(F.col("answer"))).alias("n"))
    found = marks.join(hits.select("query_id", F.col("rank").alias("n"), "passage_id"), ["query_id", "n"])
    return found.withColumn("url", F.format_string(link, F.col("passage_id").cast("string")))


def checked_answers(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, valid, invalid, cleaned): the marks that are and are not ranks of hits, and the answer without the latter."""
    sizes = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    rows = answers.join(sizes, "query_id", "left").withColumn("marks", tx.cited(F.col("answer"))).withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    ok = F.filter("marks", lambda n: (n >= 1) & (n <= F.col("n_hits")))
    rows = rows.withColumn("valid", ok).withColumn("invalid", F.array_except("marks", "valid"))
    return rows.select("query_id", "valid", "invalid", tx.strip_marks(F.col("answer"), F.col("invalid")).alias("cleaned"))


def timed(stages: DataFrame) -> DataFrame:
    """Stages (run_id, name, ms) with each one's share of its run, one per cent at least."""
    total = F.sum("ms").over(Window.partitionBy("run_id"))
    return stages.withColumn("share", F.greatest(F.round(F.col("ms") / total, 6), F.lit(0.01)))


@F.pandas_udf(ArrayType(IntegerType()))
def first_free_row(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """For spans in order, the first display row whose last span has ended by the start of each."""
    out = []
    for s, e in zip(starts, ends, strict=True):
        taken: list[int] = []  # where each display row ends; as many as spans overlap at once
        at = []
        for a, b in zip(s, e, strict=True):
            into = next((i for i, end in enumerate(taken) if end <= a), len(taken))
            taken[into : into + 1] = [b]
            at.append(into)
        out.append(at)
    return pd.Series(out)


def display_rows(chunks: DataFrame) -> DataFrame:
    """(passage_id, chunk_index, display_row): spans in order, each in the first row whose last span has ended by its start."""
    lists = chunks.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "char_start", "char_end"))).alias("all"))
    rows = lists.withColumn("at", first_free_row(F.transform("all", lambda x: x["char_start"]), F.transform("all", lambda x: x["char_end"])))
    return rows.select("passage_id", F.explode(F.arrays_zip("all", "at")).alias("x")).select("passage_id", "x.all.chunk_index", F.col("x.at").alias("display_row"))
