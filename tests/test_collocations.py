"""Names by association: the score of words that never part, and tagging against brute force."""

import random
import re

from conftest import rows_of

from quillon.functions.text import INDEX_STOP
from quillon.operators import collocations


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")


def words_of(text):
    pieces = re.findall(r"[^\W_]+(?:[-'][^\W_]+)*|[^\w\s]|_", (text or "").lower())
    return [w if w[0].isalpha() and w not in INDEX_STOP else None for w in pieces]


def brute(texts, known):
    rows = set()
    for p, text in enumerate(texts):
        words, at = words_of(text), 0
        while at < len(words):
            for n in (3, 2, 1):
                part = words[at : at + n]
                if len(part) == n and None not in part and " ".join(part) in known:
                    rows.add((p, at, n, " ".join(part)))
                    at += n - 1
                    break
            at += 1
    return rows


def test_scores(spark):
    texts = ["The ada lovelace engine.", "Ada Lovelace, engine", "by Ada Lovelace", "an engine. Room", "engine room", "room engine", None, ""]
    got = {r["name"]: (r["docs"], r["n_words"], r["score"]) for r in collocations.statistics(corpus(spark, texts), 1).collect()}
    assert got["ada lovelace"] == (3, 2, 1.0)
    assert "lovelace engine" in got and "engine room" in got and "engine. room" not in got
    assert got["ada lovelace engine"][1] == 3 and got["engine room"][0] == 1 and got["engine room"][2] < 0.5
    assert {r["name"] for r in collocations.names(collocations.statistics(corpus(spark, texts), 3)).collect()} == {"ada lovelace"}


def test_tags_are_those_of_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bo", "cy", "Dee", "the", "bo,", "7"]) for _ in range(rng.choice([0, 3, 40]))) for _ in range(60)] + [None, ""]
    known = {"bo cy", "bo cy dee", "cy dee", "dee dee", "bo", "dee cy bo", "cy cy"}
    got = collocations.tagged(corpus(spark, texts), spark.createDataFrame([(k,) for k in [*known, "bo"]], "name string"))
    rows = [tuple(r) for r in got.select("passage_id", "at", "n_words", "name").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(texts, known)


def test_repeats_and_empty(spark):
    known = spark.createDataFrame([("bo cy",)], "name string")
    twice = spark.createDataFrame([(1, "x bo cy"), (1, "x bo cy"), (1, "bo cy")], "passage_id long, text string")
    assert rows_of(collocations.tagged(twice, known).select("passage_id", "at")) == [(0, 1), (1, 1)]
    none = corpus(spark, ["x"]).where("false")
    assert collocations.statistics(none).collect() == [] and collocations.tagged(none, known).collect() == []


def test_statistics_spell_names_without_their_places(spark):
    """One list of names for a passage; no struct for each place, which was made only to be dropped."""
    rows = corpus(spark, ["ada lovelace, ada lovelace", "ada lovelace"])
    seen = []
    real = collocations.written
    collocations.written = lambda df, label: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label)
    try:
        got = {r["name"]: r["docs"] for r in collocations.statistics(rows, 1).collect()}
    finally:
        collocations.written = real
    assert got == {"ada lovelace": 2} and "Generate" in seen[0] and "struct" not in seen[0]
