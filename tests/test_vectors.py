"""Hashed words as embeddings."""


def test_hashed_words_by_batch_are_those_of_one_text(spark):
    """As text by text: sums of signs by coordinate, over their norm; empty texts and those whose signs cancel are zero."""
    import numpy as np
    import pandas as pd

    from quillon.functions import vectors

    texts = ["", "One two two three", None, "  ", "é x " * 500] + [f"word{i} Word{i % 7}" for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in rows.select("i", vectors.hashing_embedder()("t").alias("v")).collect()}
    for i, t in enumerate(texts):
        want = np.zeros(64, np.float32)
        for w in (t or "").lower().split():
            h = int(pd.util.hash_array(np.array([w], dtype=object))[0])
            want[h % 64] += 1 if h >> 63 else -1
        n = np.linalg.norm(want)
        assert got[i] == [float(x) for x in (want / n if n else want)]
