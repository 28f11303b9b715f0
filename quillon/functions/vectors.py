"""Vector expressions and the default embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; the cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of terms as binary vectors; 0 if one is empty."""
    n = F.size(a) * F.size(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.greatest(n, F.lit(1)).cast("double")))


def hashing_embedder(dim: int = 64):
    """A vectorised UDF text -> unit vector: words hashed to signed coordinates. Any model with this signature may
    take its place; one that loads weights should do so before the first batch."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for lo in range(0, len(texts), 256):  # their words are hashed together, each distinct one once
                words = [(t or "").lower().split() for t in texts.iloc[lo : lo + 256]]
                h = pd.util.hash_array(np.array([w for own in words for w in own], dtype=object))
                cells = np.repeat(np.arange(len(words)), [len(own) for own in words]) * dim + (h % dim).astype(int)
                sums = np.bincount(cells, np.where(h >> 63, 1.0, -1.0), len(words) * dim).astype(np.float32).reshape(-1, dim)
                for v in sums:
                    n = np.linalg.norm(v)
                    out.append(v / n if n else v)
            yield pd.Series(out)

    return embed


def pair_scorer(model):
    """A vectorised reranker (question, text) -> double from `model`, a function of a list of pairs; it gets Arrow blocks."""

    @F.pandas_udf("double")
    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model(list(zip(questions, texts, strict=True))), dtype="float64")

    return score
