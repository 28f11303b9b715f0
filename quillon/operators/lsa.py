"""Embeddings learned from the corpus: the leading right singular vectors of its weighted term matrix, by randomised SVD.

Rows are units, columns the `terms` most frequent terms (by units that have them, ties by term; in two units at least), an entry is ``(1 + ln tf) *
ln(N / df)`` scaled so that each row has length 1. With A that matrix and Q a random one of terms x (dim + extra) numbers,
each pass over the corpus replaces Q by an orthonormal basis of ``A^T A Q``; after `passes` of them the small matrix
``Q^T A^T A Q`` gives the singular values and, turned by its eigenvectors, the basis.

The rows are weighed once and written as numbers of terms and entries. A pass is one scan of them in Spark: tasks hold Q (at most `terms` x (dim + extra) numbers, 36 MB by default) and a sum of the same size, and hand
over a row for each term that they met; the sums meet in a shuffle by term. Nothing grows with the corpus but the scan.
A text's vector is its row times the basis, scaled to length 1, for units and questions alike (folding in), so both
are in one space. Texts without known terms, null ones too, have the zero vector. Signs of the basis are fixed by its largest entry.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..sources.files import written


@dataclass
class Basis:
    """Terms with their weights ln(N / df), the basis (terms x dim) and the singular values."""

    terms: list[str]
    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def row(self, tokens: list[str], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and entries of a unit's row."""
        counts = Counter(at[t] for t in tokens if t in at)
        columns = np.fromiter(counts, np.int64, len(counts))
        entries = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[columns]
        size = np.linalg.norm(entries)
        return (columns, entries / size) if size else (columns[:0], entries[:0])


def vocabulary(tokenised: DataFrame, terms: int) -> tuple[list[str], np.ndarray]:
    """The terms and their weights; `tokenised` has `tokens`."""
    n = tokenised.count()
    df = tokenised.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 2")
    top = df.orderBy(F.desc("df"), "term").limit(terms).toArrow()  # at most `terms` rows
    return top["term"].to_pylist(), np.log(n / top["df"].to_numpy().astype(float)) if len(top) else np.zeros(0)


def weighed(tokenised: DataFrame, model: Basis, part: int = 256) -> DataFrame:
    """(columns, entries): the rows of A, without empty ones; all passes read these instead of the tokens. Tokens are taken by `part` units."""
    sent = tokenised.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        at = {t: i for i, t in enumerate(own.terms)}
        for batch in batches:
            for lo in range(0, batch.num_rows, part):
                rows = [own.row(tokens or [], at) for tokens in batch.column("tokens").slice(lo, part).to_pylist()]
                rows = [r for r in rows if len(r[0])]
                if rows:
                    ends = pa.array(np.cumsum([0, *(len(c) for c, _ in rows)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]).astype(t))) for i, t in ((0, np.int32), (1, np.float64))], names=["columns", "entries"])

    return tokenised.select("tokens").mapInArrow(run, "columns array<int>, entries array<double>")


def passed(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A^T A q of the rows of A (`weighed`)."""
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        sums, met = np.zeros_like(q), np.zeros(len(q), bool)
        for batch in batches:
            ends = np.cumsum(batch.column("columns").value_lengths().to_numpy())[:-1]
            every = [np.split(batch.column(c).flatten().to_numpy(), ends) for c in ("columns", "entries")] if batch.num_rows else [[], []]
            for columns, entries in zip(*every, strict=True):
                sums[columns] += entries[:, None] * (entries @ q[columns])
                met[columns] = True
        seen = np.flatnonzero(met)
        for lo in range(0, len(seen), 4096):
            part = seen[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.FixedSizeListArray.from_arrays(pa.array(sums[part].ravel()), q.shape[1]).cast(pa.list_(pa.float64()))], names=["term", "sums"])

    width = q.shape[1]
    summed = rows.select("columns", "entries").mapInArrow(run, "term long, sums array<double>")
    total = summed.groupBy("term").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).toArrow()  # a row for each term
    out = np.zeros_like(q)
    if len(total):
        out[total["term"].to_numpy()] = np.column_stack([total[f"s{i}"].to_numpy() for i in range(width)])
    return out


def learn(units: DataFrame, dim: int = 64, terms: int = 50_000, extra: int = 16, passes: int = 4, seed: int = 22, stop: list[str] | None = None) -> Basis:
    """The basis of `units` (text)."""
    tokenised = written(units.select(tx.index_tokens(F.col("text"), stop).alias("tokens")), "lsa-tokens")
    names, idf = vocabulary(tokenised, terms)
    width = min(dim + extra, len(names))
    model = Basis(names, idf, np.zeros((len(names), 0)), np.zeros(0))
    if not width:
        return model
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names), width)))[0]
    rows = written(weighed(tokenised, model), "lsa-rows")
    for _ in range(passes):
        q = np.linalg.qr(passed(rows, q))[0]
    small = q.T @ passed(rows, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[: min(dim, width)]
    basis = q @ turn[:, best]
    signs = np.sign(basis[np.abs(basis).argmax(0), np.arange(len(best))])
    return Basis(names, idf, basis * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[best], 0)))


def save(spark, model: Basis, path: str) -> None:
    """One row for each term, and the values."""
    rows = [(t, float(w), [float(x) for x in b]) for t, w, b in zip(model.terms, model.idf, model.basis, strict=True)]
    rows.append((None, 0.0, [float(x) for x in model.values]))
    spark.createDataFrame(rows, "term string, idf double, basis array<double>").write.parquet(path)


def load(spark, path: str) -> Basis:
    rows = spark.read.parquet(path).orderBy("term").toArrow()  # at most `terms` rows, as they were learned
    values = [r for r in rows.to_pylist() if r["term"] is None][0]["basis"]
    own = [r for r in rows.to_pylist() if r["term"] is not None]
    return Basis([r["term"] for r in own], np.array([r["idf"] for r in own]), np.array([r["basis"] for r in own]).reshape(len(own), -1), np.array(values))


def embedder(spark, model: Basis, stop: list[str] | None = None):
    """A function text -> unit vector (array<float>), as `Engine` takes it."""
    sent = spark.sparkContext.broadcast(model)
    width = max(1, model.basis.shape[1])

    @F.pandas_udf("array<float>")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        at = {t: i for i, t in enumerate(own.terms)}
        for texts in batches:
            out = []
            for tokens in texts:
                columns, entries = own.row([] if tokens is None else list(tokens), at)
                v = entries @ own.basis[columns] if len(columns) else np.zeros(width)
                size = np.linalg.norm(v)
                out.append((v / size if size else v).astype(np.float32).tolist())
            yield pd.Series(out)

    return lambda text: fold(tx.index_tokens(text, stop))
