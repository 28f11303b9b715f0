"""Texts and tables that every operator must take: nulls, empty and long texts, repeated rows, odd columns."""

import re

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n):
    syllables = ["ba", "re", "ti", "on", "ké", "ü", "sho", "lan", "mi", "x"]
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(n))


def odd_docs(spark, extra=True):
    """Two dozen documents with every oddity, and columns whose names clash with the operators' own."""
    rng = np.random.default_rng(3)
    base = prose(rng, 80)
    words = base.split()
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace(" ", "\n", 9).replace("a", "A").replace("r", "R"), "en", "a"),
        (4, " ".join(words[:79] + ["other"]), "fr", "b"),
        (5, " ".join(words[:70] + ["else"] * 10), "fr", None),
        (6, None, "de", "b"),
        (7, "", "de", "b"),
        (8, " \t\n ", None, "c"),
        (9, "word", "en", "c"),
        (10, "word", "en", "c"),
        (11, "two words", "en", "c"),
        (12, "😀 emoji 😀 é ß", "en", "c"),
        (13, prose(rng, 20_000), "en", "a"),
        (14, prose(rng, 400), "en", "a"),
        (14, prose(rng, 30), "en", "a"),
        (15, "same row", "en", "a"),
        (15, "same row", "en", "a"),
        (None, "without id", "en", "a"),
        (None, base, "en", "a"),
        (-7, "x" * 70_000, "en", None),
        (2**62, "a b c d e", "en", "ü"),
    ]
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)
    if extra:
        for name in ("size", "key", "norm", "kept", "score", "sketch", "row", "path", "host", "sequence_id"):
            df = df.selectExpr("*", f"'{name}' as {name}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def random_docs(spark, n=150, seed=1):
    """Documents with exact copies, near copies and small changes of white space."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            w = texts[rng.integers(len(texts))].split(" ")
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = "new" + str(rng.integers(50))
            texts.append(" ".join(w))
        else:
            texts.append(prose(rng, int(rng.choice([1, 3, 5, 8, 40, 120, 200]))))
    source = [None if rng.random() < 0.1 else "s" + str(min(4, int(rng.exponential(1.5)))) for _ in texts]
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, source))], DOCS)
