"""Sentence boundaries learned from the corpus: abbreviations by their statistics, without a list of them.

A word before a full stop is an abbreviation if the stop belongs to it: the log-likelihood ratio of "nearly always a stop follows" (0.99)
against "a stop follows as often as after any word", weighed down by the word's length without stops (e^-n), up by its inner stops
(n + 1), and down by each time it stands without a stop (n^-times); from `least` on it is one. Words are taken in lower case
without their last stop; numbers are none.

The statistics are one aggregate over the corpus: each task counts words before they are shuffled, so a frequent word is a row a task.
A break of the pattern of sentences falls away behind an abbreviation, where the next sentence is joined to the one before. Only ids,
places and the words at breaks meet the abbreviations, which are sent to all tasks if there are at most `most` (else the join shuffles);
the text stays where it is until the breaks are known.

A text without breaks, or empty, is one sentence; a null text has none; repeated passage ids are told apart by their texts,
and rows that repeat wholly are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..sources.tables import small
from . import chunking

WORD = r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}.]*$"  # a word without the marks around it
LEAST = 0.3


def bare(word: Column) -> Column:
    """A word in lower case, without marks around it but its stops."""
    return F.lower(F.regexp_extract(word, WORD, 1))


def counts(passages: DataFrame) -> DataFrame:
    """(word, with_stop, without): how often each word has a stop behind it and how often not; without its last stop."""
    rows = passages.select(F.explode(F.split("text", " ")).alias("w")).select(bare(F.col("w")).alias("w"))
    ends = F.col("w").endswith(".")
    words = rows.select(F.when(ends, F.substr("w", F.lit(1), F.length("w") - 1)).otherwise(F.col("w")).alias("word"), ends.alias("ends"))
    return words.where(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.count_if("ends").alias("with_stop"), F.count_if(~F.col("ends")).alias("without"))


def scores(counted: DataFrame) -> DataFrame:
    """(word, with_stop, without, score) of the words that ever have a stop."""
    total = counted.agg(F.sum("with_stop").alias("stops"), (F.sum("with_stop") + F.sum("without")).alias("n_words"))
    k, n = F.col("with_stop"), F.col("with_stop") + F.col("without")
    p = F.col("stops") / F.col("n_words")
    free = k * F.ln(p) + F.when(p < 1, F.col("without") * F.ln(1 - p)).otherwise(0.0)
    bound = k * F.ln(F.lit(0.99)) + F.col("without") * F.ln(F.lit(0.01))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = F.length("word") - inner
    score = 2 * (bound - free) * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -F.col("without").cast("double"))
    return counted.where("with_stop > 0").crossJoin(F.broadcast(total)).select("word", "with_stop", "without", F.round(score, 6).alias("score"))  # total is one row


def abbreviations(passages: DataFrame, least: float = LEAST) -> DataFrame:
    """(word): the abbreviations of a corpus (passage_id, text)."""
    return scores(counts(passages)).where(F.col("score") >= least).select("word")


def sentence_rows(passages: DataFrame, known: DataFrame, most: int = 100_000) -> DataFrame:
    """(passage_id, i, s, e): the sentences of normalised texts, in place of the pattern's, of which those behind one of `known` (word) are joined."""
    # The text's hash and list lie below the generated rows, which would else each take the whole text along and hash it.
    listed = passages.select("passage_id", F.xxhash64("text").alias("of"), chunking.sentence_list(F.col("text")).alias("all"))
    found = listed.select("passage_id", "of", F.explode("all").alias("x"))
    rows = found.select("passage_id", "of", "x.i", "x.s", "x.e", bare(F.element_at(F.split("x.sentence", " "), -1)).alias("w"))
    rows = rows.withColumn("word", F.when(F.col("w").endswith("."), F.substr("w", F.lit(1), F.length("w") - 1)))
    held = rows.join(small(known.select("word", F.lit(True).alias("abbreviated")), most), "word", "left")
    held = held.repartition("passage_id", "of").distinct()  # rows that repeat wholly are one; all that follows lies so
    by_text = Window.partitionBy("passage_id", "of").orderBy("s")
    opens = F.coalesce(~F.lag("abbreviated").over(by_text), F.lit(True))
    grouped = held.withColumn("i", F.sum(opens.cast("int")).over(by_text) - 1)
    return grouped.groupBy("passage_id", "of", "i").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("passage_id", F.col("i").cast("int").alias("i"), "s", "e")
