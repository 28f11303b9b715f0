"""Lexical retrieval without an index: the best units of several strategies for few questions, in two passes over the texts.

Where an index serves one batch of questions alone, making and reading it costs more than what it spares: all postings are written, and
those of the questions' terms, most of them, move to their units. Here texts are cut, tokenised and counted where they are, first for the
frequencies of the questions' terms and the numbers of each strategy, then for scores; a task hands on what is among its own k best.
Rows are those of `retrieve.bm25_indexed` and `retrieve.term_cosine_indexed`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import points
from ..functions import text as tx
from . import chunking, index, retrieve
from .ranking import top_hits

KINDS = ("bm25", "terms")
CELLS = 2_000_000
N_UNITS, LENGTH = -1, -2  # what stands for a strategy's numbers beside the places of terms


def units_of(cuts: list[chunking.Cut], stopped: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, index.Counts]]:
    """(the number of a cut, the passage of each of its units, their places, their counts) of each part of `batches`."""
    for batch in batches:
        for part, texts in points.parts(batch):
            cps, starts = points.points(texts)
            ids = part.column("passage_id").to_numpy()
            before = {wide: points.tokens_before(cps, starts, wide) for wide in {chunking.wide_of(c) for c in cuts}}
            for i, cut in enumerate(cuts):
                owner, s, e = cut(cps, starts, before[chunking.wide_of(cut)])
                a, b = s - starts[owner], e - starts[owner]
                low = [texts[t][x:y].lower() for t, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True)]
                yield i, ids[owner], chunking.nth(owner, len(texts)), index.Counts.of(low, stopped)


def lists(questions: DataFrame, passages: DataFrame, cuts: dict[str, chunking.Cut], k: int, k1: float = 1.2, b: float = 0.75, stop: list[str] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(strategy, kind, query_id, chunk_id, passage_id, score, rank): the k best units of each question by BM25 (kind bm25) and by the cosine of
    binary term vectors (terms), or one of them. Questions are few (`retrieve.few`): what is made of them goes to all tasks."""
    spark, names, made = questions.sparkSession, list(cuts), list(cuts.values())
    stopped = list(tx.INDEX_STOP if stop is None else stop)
    asked = retrieve.index_terms(questions, stop).toArrow()  # at most a few dozen rows for each of the few questions
    words = list(dict.fromkeys(asked["term"].to_pylist()))
    at_word, ids = {t: i for i, t in enumerate(words)}, np.array(sorted(set(asked["query_id"].to_pylist())), np.int64)
    cells = np.array([[at_word[t], q, n] for t, q, n in zip(*(asked[c].to_pylist() for c in ("term", "query_id", "qf")), strict=True)], np.int64).reshape(-1, 3)
    cells = cells[np.argsort(cells[:, 0], kind="stable")]  # a term's questions follow each other
    question = np.searchsorted(ids, cells[:, 1])
    sizes = np.bincount(cells[:, 0], minlength=len(words))
    opens = np.cumsum(sizes) - sizes
    n_asked = np.bincount(question, minlength=len(ids))  # distinct terms of each question
    vocabulary = pa.array(words, pa.string())
    texts = passages.select(F.col("passage_id").cast("long").alias("passage_id"), "text")

    def of_asked(c: index.Counts) -> tuple[np.ndarray, np.ndarray]:
        """The places in `c` of asked terms, and which they are."""
        which = pc.index_in(c.words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[c.code]
        here = np.flatnonzero(which >= 0)
        return here, which[here]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros((len(made), len(words)), np.int64), np.zeros(len(made), np.int64), np.zeros(len(made), np.int64)
        for i, owner, _, c in units_of(made, stopped, batches):
            df[i] += np.bincount(of_asked(c)[1], minlength=len(words))
            n[i] += len(owner)
            length[i] += int(c.dl.sum(dtype=np.int64))
        nth, term = np.nonzero(df)
        every = np.arange(len(made))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([nth, every, every])), pa.array(np.concatenate([term, np.full(len(made), N_UNITS), np.full(len(made), LENGTH)])), pa.array(np.concatenate([df[nth, term], n, length]))], names=["nth", "term", "n"])

    counts = texts.mapInArrow(count, "nth long, term long, n long").groupBy("nth", "term").agg(F.sum("n").alias("n"))
    got = {(r["nth"], r["term"]): r["n"] for r in counts.collect()}  # a row for each strategy and asked term
    rows = [(i, t, n, got[i, N_UNITS]) for (i, t), n in got.items() if t >= 0]
    weighed = spark.createDataFrame(rows, "nth long, term long, df long, n long").select("nth", "term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf, mean = np.zeros((len(made), len(words))), [got.get((i, LENGTH), 0) / max(1, got.get((i, N_UNITS), 0)) for i in range(len(made))]
    for r in weighed.collect():
        idf[r["nth"], r["term"]] = r["idf"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(i, kind): np.full((len(ids), k), -np.inf) for i in range(len(made)) for kind in kinds}
        for i, owner, place, c in units_of(made, stopped, batches):
            here, term = of_asked(c)
            if not len(here):
                continue
            dl, tf = c.dl[c.unit[here]], c.tf[here]
            part = idf[i, term] * (tf / (tf + k1 * (1 - b + b * dl / mean[i])))
            new = np.concatenate([[True], c.unit[here][1:] != c.unit[here][:-1]])
            first, nth = np.flatnonzero(new), np.cumsum(new) - 1
            units = c.unit[here][first]
            # Units are taken together as far as their matrix and their postings' questions stay within a few million cells.
            cost = np.cumsum(np.add.reduceat(sizes[term], first) + len(ids)) // CELLS
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(cost)) + 1, [len(first)]])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                x, y = first[lo], first[hi] if hi < len(first) else len(here)
                many = sizes[term[x:y]]
                row = np.repeat(np.arange(x, y), many)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + opens[term[row]]
                at, size = (nth[row] - lo) * len(ids) + question[cell], (hi - lo) * len(ids)
                found = {}
                if "bm25" in kinds:
                    found["bm25"] = np.bincount(at, cells[cell, 2] * part[row], size).reshape(-1, len(ids))
                if "terms" in kinds:
                    found["terms"] = np.bincount(at, minlength=size).reshape(-1, len(ids)) / np.sqrt((n_asked * c.n_terms[units[lo:hi], None].astype(np.int64)).astype(float))
                for kind, matrix in found.items():
                    u, q, s, best[i, kind] = retrieve.best_pairs(matrix, best[i, kind], chunking.rounded if kind == "terms" else np.round)
                    unit = units[lo + u]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), i)), pa.array([kind] * len(u), pa.string()), pa.array(ids[q]), pa.array(owner[unit]), pa.array(place[unit]), pa.array(s)], names=["nth", "kind", "query_id", "passage_id", "chunk_index", "score"])

    scored = texts.mapInArrow(score, "nth long, kind string, query_id long, passage_id long, chunk_index long, score double")
    strategy = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("nth") + 1).cast("int"))
    hits = scored.select(strategy.alias("strategy"), "kind", "query_id", chunking.chunk_id(F.col("passage_id"), F.col("chunk_index")).alias("chunk_id"), "passage_id", "score")
    return top_hits(hits, k, ("strategy", "kind", "query_id"))
