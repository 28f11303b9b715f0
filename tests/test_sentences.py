"""Learned sentence boundaries: abbreviations are found and do not split; spans against brute force."""

import math
import re
from collections import Counter

from quillon.operators import sentences

PROSE = "We met Dr. Brown at noon. He had come from St. Ives with Dr. Green. The doctor was late, e.g. On Mondays he often is. Nobody (not even Prof. White) was there. It rained. It rained again. "


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")


def brute(texts):
    """The abbreviations of texts, by the definition."""
    with_stop, without = Counter(), Counter()
    for text in texts:
        for w in (text or "").split(" "):
            w = re.match(r"^[\W_]*(.*?)[^\w.]*$", w)[1].lower()
            if re.search(r"[^\W\d_]", w):
                (with_stop if w.endswith(".") else without)[w.removesuffix(".")] += 1
    stops, n = sum(with_stop.values()), sum(with_stop.values()) + sum(without.values())
    found = set()
    for w, k in with_stop.items():
        m, p, inner = without[w], stops / n, w.count(".")
        free = k * math.log(p) + (m * math.log(1 - p) if p < 1 else 0)
        size = len(w) - inner
        if round(2 * (k * math.log(0.99) + m * math.log(0.01) - free) * math.exp(-size) * (inner + 1) * size**-m, 6) >= 0.3:
            found.add(w)
    return found


def test_abbreviations(spark):
    texts = [PROSE * 8, "It rained where the doctor was. Again it rained at noon. A brown and green Monday.", "Is it noon? It is past noon here, is it not; there it is before noon, which is late. " * 4, "", None]
    found = {r["word"] for r in sentences.abbreviations(corpus(spark, texts)).collect()}
    assert found == brute(texts)
    assert {"dr", "st", "e.g"} <= found and not {"rained", "again", "noon", "is", "there"} & found


def test_spans(spark):
    texts = [PROSE.strip(), "One. Two dr. Three", "Dr. Dr. Dr. Who", "", "no end", None]
    known = spark.createDataFrame([("dr",), ("st",), ("e.g",), ("prof",)], "word string")
    got = sorted(tuple(r) for r in sentences.sentence_rows(corpus(spark, texts), known).collect())
    want = []
    for i, text in enumerate(texts):
        if text is None:
            continue
        begins, at = [0], 0
        for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])", text):
            last = re.match(r"^[\W_]*(.*?)[^\w.]*$", text[: m.start()].split(" ")[-1])[1].lower()
            if not (last.endswith(".") and last[:-1] in {"dr", "st", "e.g", "prof"}):
                begins.append(m.end())
        ends = [b - 1 for b in begins[1:]] + [len(text)]
        want += [(i, at, s, e) for at, (s, e) in enumerate(zip(begins, ends, strict=True))]
    assert got == want
    assert [texts[0][s:e] for i, _, s, e in got if i == 0][:2] == ["We met Dr. Brown at noon.", "He had come from St. Ives with Dr. Green."]


def test_repeated_rows_and_empty(spark):
    two = spark.createDataFrame([(1, "A dr. B. C."), (1, "X. Y."), (1, "X. Y.")], "passage_id long, text string")
    known = spark.createDataFrame([("dr",)], "word string")
    assert sorted(tuple(r) for r in sentences.sentence_rows(two, known).collect()) == [(1, 0, 0, 2), (1, 0, 0, 8), (1, 1, 3, 5), (1, 1, 9, 11)]
    none = corpus(spark, ["x"]).where("false")
    assert sentences.abbreviations(none).collect() == [] and sentences.sentence_rows(none, known).collect() == []


def test_learned_sentences_carry_no_text(spark):
    """A generated sentence takes a hash of its passage along, not the text."""
    passages = spark.createDataFrame([(1, "One two. Three four.")], "passage_id long, text string")
    plan = sentences.sentence_rows(passages, spark.createDataFrame([("dr",)], "word string"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert min(i for i, line in enumerate(plan) if "xxhash64(text" in line) > at
