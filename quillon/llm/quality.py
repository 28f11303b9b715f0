"""Document quality by hierarchical empirical Bayes: a document classifier, and the sites the documents come from.

* *Document.* A logistic model over rates of bytes and words (features in numpy, a few dozen numbers for each text),
  fitted on at most `max_rows` labelled documents chosen by a hash of doc_id (a documented bound; only their features
  reach the driver).
* *Sites.* Every path (which lies in a host) counts its labelled documents, good ones and all, and adds its other documents
  as `trust` of a document each, good by the classifier's probability. A host's quality has a beta prior around the global
  mean and a path's one around its host's posterior mean; the strength of either prior comes from the spread between
  sites, by the method of moments, so that sparse sites shrink to their parent and large ones speak for themselves.
* *Both.* A document's log odds are its own plus those of its path's posterior against the global mean; its own share, label
  included, is taken out of the path's counts first. The classifier and the host's sums still hold its label, so scores of
  labelled documents are in-sample; `held_out` names a fold whose labels are used nowhere, for scores that are not.

Sites are sent to all executors only as long as there are at most `max_broadcast`; beyond, rows meet them in a shuffle
in which every site's rows are spread over `salts` tasks, as one host may hold a third of all rows.

Null and empty texts have all features 0. Null hosts and paths are sites of their own. Labels other than 0 and 1 are not
used; without labels of both classes the classifier gives the share of 1 (one half without labels). Labels repeated for one
doc_id count once, the best of them; of rows repeated with one labelled doc_id one trains the classifier. Rows with one
doc_id are scored each for itself, and each counts in its site. Very long texts are read whole, one at a time. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec
from .common import stored

_SIGNS = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
N_FEATURES = len(_SIGNS) + 11


def features(texts: pa.Array) -> np.ndarray:
    """texts x N_FEATURES: square roots of the rates of signs, letter cases, digits, blanks and repeated words."""
    b, offsets = textvec.raw(texts, lower=False)
    h, at = textvec.words(texts)
    out = np.zeros((len(texts), N_FEATURES))
    for i in range(len(texts)):
        own, w = b[offsets[i] : offsets[i + 1]], h[at[i] : at[i + 1]]
        if not len(w):
            continue
        n = np.bincount(own, minlength=256)
        _, times = np.unique(w, return_counts=True)
        rates = [n[65:91].sum(), n[97:123].sum(), n[48:58].sum(), n[10], n[32] + n[9], n[128:].sum()]
        out[i, : len(_SIGNS)] = n[_SIGNS] / len(own)
        out[i, len(_SIGNS) : len(_SIGNS) + 6] = np.array(rates) / len(own)
        repeat = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0
        out[i, len(_SIGNS) + 6 :] = [repeat, len(times) / len(w), times.max() / len(w), min(1.0, len(w) / len(own)), min(1.0, np.log1p(len(w)) / 12)]
    return np.sqrt(out)


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(np.hstack([z, z * z]) @ self.weight + self.bias, -12, 12)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Linear:
    """Logistic regression on standardised features and their squares, by damped Newton's steps."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    weight, share = np.zeros(2 * N_FEATURES), float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        return Linear(mean, scale, weight, float(np.clip(np.log(max(share, 1e-5) / max(1 - share, 1e-5)), -12, 12)))
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack([z, z * z, np.ones((len(x), 1))])
    w = np.append(weight, np.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * np.append(w[:-1], 0)
        m = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(m, g)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in textvec.slices(batch.column("text")):
            x = features(texts)
            rest = [batch.column(c).slice(lo, len(texts)) for c in ("doc_id", "quality")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "quality", "x"])


def evidence_rows(batches: Iterator[pa.RecordBatch], model: Linear) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in textvec.slices(batch.column("text")):
            rest = [batch.column(c).slice(lo, len(texts)) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.logits(features(texts)), pa.float64())], names=["doc_id", "host", "path", "evidence"])


def fold(of: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(of.cast("string").cast("binary")), F.lit(n))


def known(labels: DataFrame, held_out: int | None) -> DataFrame:
    """(doc_id, quality): one label of each document, but those of the fold `held_out`."""
    rows = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null")
    if held_out is not None:
        rows = rows.where(fold(F.col("doc_id")) != held_out)
    return rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 8) -> Linear:
    """The classifier; `labels`: (doc_id, quality), one for each doc_id."""
    picked = labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_rows ids, so it may be broadcast. One row of each doc_id stays: that with the least features.
    made = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(feature_rows, "doc_id long, quality int, x binary")
    found = made.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float64).reshape(-1, N_FEATURES)
    return fit_linear(x, np.array(found["quality"].to_pylist(), np.float64))


def strength(of: DataFrame, parent: str) -> float:
    """The prior's strength, in documents, from sites with sums `s` over `n` and their parents' mean, by moments."""
    rate = F.col("s") / F.col("n")
    row = of.agg(F.count("*").alias("k"), F.sum(F.col("n") * (rate - F.col(parent)) ** 2).alias("between"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("v")).first()
    if not row["k"] or not row["v"]:
        return 1.0
    within = row["v"] / row["n"]  # variance of one document
    spread = max((row["between"] - row["k"] * within) / row["n"], within * 1e-4)
    return float(np.clip(within / spread - 1, 1.0, 1e4))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_rows: int = 20_000, seed: int = 8, max_broadcast: int = 200_000, salts: int = 32, trust: float = 0.25, held_out: int | None = None) -> DataFrame:
    """(doc_id, host, path, evidence, host_quality, path_quality, score, keep) for each row of `docs`.

    `host` and `path`: columns of `docs`; `evidence`: the classifier's log odds; `score`: probability of quality 1;
    `keep`: whether it is at least one half. `held_out`: a fold of doc_id whose labels are not used at all.
    """
    spark = docs.sparkSession
    labels = known(labels, held_out)
    model = fit(docs, labels, max_rows, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    evidence = stored(rows.mapInArrow(lambda it: evidence_rows(it, model), "doc_id long, host string, path string, evidence double"), "evidence")
    judged = evidence.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "left")  # labels meet numbers, not texts
    judged = stored(judged.select("doc_id", "host", "path", "label", "evidence"), "judged")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    own_n = F.when(F.col("label").isNull(), F.lit(trust)).otherwise(F.lit(1.0))
    own_s = F.when(F.col("label").isNull(), trust * p).otherwise(F.col("label").cast("double"))
    paths = stored(judged.groupBy("host", "path").agg(F.sum(own_s).alias("s"), F.sum(own_n).alias("n")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("mean", F.lit(float(mean)))
    a = strength(hosts, "mean")
    hosts = stored(hosts.select(F.col("host").alias("of"), ((F.col("s") + a * mean) / (F.col("n") + a)).alias("host_quality")), "hosts")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("of")))
    b = strength(sites, "host_quality")
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "s", "n", "host_quality")
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q"))
    if paths.count() <= max_broadcast:
        met = judged.join(F.broadcast(sites), same)
    else:
        salted = sites.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(salts)).cast("int")).join(salted, same & (F.col("salt") == F.col("t")))
    left = lambda c, own: F.greatest(F.col(c) - own, F.lit(0.0))  # noqa: E731  sums may miss zero by their rounding
    path_quality = (left("s", own_s) + b * F.col("host_quality")) / (left("n", own_n) + b)
    score = 1 / (1 + F.exp(-(F.col("evidence") + logit(path_quality) - logit(F.lit(float(mean))))))
    return met.select("doc_id", "host", "path", "evidence", "host_quality", path_quality.alias("path_quality"), score.alias("score")).withColumn("keep", F.col("score") >= 0.5)
