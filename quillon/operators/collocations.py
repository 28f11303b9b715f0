"""Names found by statistics: sequences of words that stand together in more passages than their words would by chance.

`statistics` counts, for every sequence of one to `LONGEST` words, the passages that hold it; a passage names each of its sequences
once, and counts are added within a task before they are shuffled. A sequence is scored by its normalised pointwise mutual
information, (ln p - sum of ln p of its words) / (-(n - 1) ln p), where p is a share of passages: 1 if the words never stand apart, 0 if
they meet by chance (and for a sequence in all passages, which shows nothing). Sequences do not run over marks, and neither
stop words nor words that begin with a digit are in them.

`tagged` finds the names in passages, longest first from the left, without overlap. Places meet names by an equi join, so any number of
names will do: they are sent to all tasks if they are few, else the join shuffles and a frequent name's places may be split.

Null and empty texts have no sequences; rows that repeat wholly are tagged once, but count as often as they are there; rows with one
passage_id and different texts are told apart by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import text as tx
from ..sources.files import written
from ..sources.tables import small

LONGEST = 3
PIECE = r"[\p{L}\p{N}]+(?:[\-'][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def marked(text: Column) -> Column:
    """array<string>: the words of a text in lower case, null where a mark, a stop word or a number is."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))
    return F.transform(pieces, lambda w: F.when(w.rlike(r"^\p{L}") & ~w.isin(*tx.INDEX_STOP), w))


def spelled(words: str, n: int) -> Callable[[Column, Column], Column]:
    """A function of a word and its place in a column made by `marked`: the sequence of `n` words that begins there, null if one of them is."""
    return lambda w, i: w if n == 1 else F.concat(w, *[x for j in range(1, n) for x in (F.lit(" "), F.get(words, i + j))])


def sequences(words: str, n: int) -> Column:
    """array<struct<at, n, name>>: the sequences of `n` words in a column made by `marked`."""
    name = spelled(words, n)
    return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.lit(n).alias("n"), name(w, i).alias("name"))), lambda x: x["name"].isNotNull())


def statistics(passages: DataFrame, least: int = 3) -> DataFrame:
    """(name, docs, n_words, score) of the sequences of two words and more in at least `least` passages."""
    # Names alone, without their places; the null ones go as rows, after those of a passage have become one.
    each = F.array_distinct(F.concat("words", *[F.transform("words", spelled("words", n)) for n in range(2, LONGEST + 1)]))
    rows = passages.select(F.explode(F.array(marked(F.col("text")))).alias("words")).select(F.explode(each).alias("name")).where("name is not null")
    # A word of a sequence is in all its passages, so the rare ones may go before the two meet.
    counted = written(rows.groupBy("name").agg(F.count("*").alias("docs")).where(F.col("docs") >= least), "sequences")
    total = passages.agg(F.count("*").alias("total"))
    long = counted.where(F.contains("name", F.lit(" "))).select("name", "docs", F.explode(F.split("name", " ")).alias("word"))
    single = counted.where(~F.contains("name", F.lit(" "))).select(F.col("name").alias("word"), F.col("docs").alias("own"))
    met = long.join(single, "word").crossJoin(F.broadcast(total))  # one row
    apart = met.groupBy("name", "docs", "total").agg(F.sum(F.ln(F.col("own") / F.col("total"))).alias("apart"), F.count("*").alias("n_words"))
    together = F.ln(F.col("docs") / F.col("total"))
    score = F.when(F.col("docs") == F.col("total"), 0.0).otherwise((together - F.col("apart")) / (-(F.col("n_words") - 1) * together))
    return apart.select("name", "docs", "n_words", F.round(score, 6).alias("score"))


def names(found: DataFrame, least: float = 0.5) -> DataFrame:
    """(name, docs): the sequences of `statistics` that are names."""
    return found.where(F.col("score") >= least).select("name", "docs")


@F.pandas_udf(ArrayType(IntegerType()))
def chosen(spans: pd.Series) -> pd.Series:
    """The starts of the spans (at * 4 + n) that stay: from the left, the longest at each place, none over another."""
    out = []
    for codes in spans:
        end, kept = -1, []
        longest = {}
        for code in codes:
            longest[code >> 2] = max(longest.get(code >> 2, 0), code & 3)
        for at in sorted(longest):
            if at >= end:
                kept.append(at * 4 + longest[at])
                end = at + longest[at]
        out.append(kept)
    return pd.Series(out)


def tagged(passages: DataFrame, known: DataFrame) -> DataFrame:
    """(passage_id, at, n_words, name): where `known` (name) stand in passages, by the place of their first word or mark."""
    # Written, as they are counted and then met; places of other lengths than theirs need not meet them.
    known = written(known.select("name").distinct(), "names")
    sizes = {r["n"] for r in known.select(F.size(F.split("name", " ")).alias("n")).where(F.col("n") <= LONGEST).distinct().collect()} or {1}
    every = F.flatten(F.array(*[sequences("words", n) for n in sorted(sizes)]))
    rows = passages.select("passage_id", F.xxhash64("text").alias("of"), F.explode(F.array(marked(F.col("text")))).alias("words"))
    places = rows.select("passage_id", "of", F.explode(every).alias("x")).select("passage_id", "of", "x.*")
    met = places.join(small(known), "name").select("passage_id", "of", (F.col("at") * 4 + F.col("n")).alias("code"), "name")
    lists = met.groupBy("passage_id", "of").agg(F.collect_set(F.struct("code", "name")).alias("met"))  # a passage's own names
    kept = lists.select("passage_id", "met", chosen(F.transform("met", lambda x: x["code"])).alias("kept"))
    stay = kept.select("passage_id", F.explode("met").alias("x"), "kept").where(F.array_contains("kept", F.col("x.code")))
    return stay.select("passage_id", F.shiftright("x.code", 2).alias("at"), F.col("x.code").bitwiseAND(3).alias("n_words"), F.col("x.name").alias("name"))
