import numpy as np
import pyarrow as pa
import pytest
from cases import no_docs, odd_docs, prose
from pyspark.sql import functions as F

from quillon.llm import quality


def corpus(spark, n=300):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < (0.8 if i % 10 == 3 else 0.1)
        text = prose(rng, 40)
        text = text.upper().replace(" ", "!! ") if bad else text.capitalize() + "."
        rows.append((i, text, f"host{i % 10}"))
        if i % 3:
            labels.append((i, int(not bad)))
    truth = {i: int("!!" not in t) for i, t, _ in rows}
    return spark.createDataFrame(rows, "doc_id long, text string, site string"), spark.createDataFrame(labels, "doc_id long, quality int"), truth


@pytest.mark.parametrize("most", [200_000, 0])
def test_held_out_accuracy(spark, most):
    docs, labels, truth = corpus(spark)
    got = quality.quality_scores(docs, labels, F.col("site"), F.concat("site", F.lit("/p")), max_broadcast=most).collect()
    assert len(got) == len(truth)
    assert np.mean([r["keep"] == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] % 3 == 0]) > 0.97
    hosts = {r["host"]: r["host_quality"] for r in got}
    assert min(hosts, key=hosts.get) == "host3" and all(0 < v < 1 for v in hosts.values())


def test_sparse_sites_shrink_to_their_parent(spark):
    docs, labels, _ = corpus(spark)
    one = docs.limit(1).select(F.lit(9999).cast("long").alias("doc_id"), F.lit("BAD!! BAD!! BAD!!").alias("text"), F.lit("tiny").alias("site"))
    got = quality.quality_scores(docs.unionByName(one), labels, F.col("site"), F.col("site")).collect()
    hosts = {r["host"]: r["host_quality"] for r in got}
    assert hosts["tiny"] > hosts["host3"] - 0.2 and hosts["tiny"] > 0.3


def moments(sites):
    """The prior's strength from (s, n, parent's mean) of each site."""
    total = sum(n for _, n, _ in sites)
    v = sum(n * m * (1 - m) for _, n, m in sites)
    if not v:
        return 1.0
    within, between = v / total, sum(n * (s / n - m) ** 2 for s, n, m in sites)
    spread = max((between - len(sites) * within) / total, within * 1e-4)
    return min(max(within / spread - 1, 1.0), 1e4)


def posteriors(rows, labels, trust):
    """{doc_id: (host's posterior, path's posterior without the document, score)} from the classifier's evidence, one document
    after the other. rows: (doc_id, host, path, evidence)."""
    share = lambda e: 1 / (1 + np.exp(-e))
    own = {i: (labels[i], 1.0) if i in labels else (trust * share(e), trust) for i, _, _, e in rows}
    paths, hosts = {}, {}
    for i, h, q, _ in rows:
        for sums, key in ((paths, (h, q)), (hosts, h)):
            s, n = sums.get(key, (0.0, 0.0))
            sums[key] = s + own[i][0], n + own[i][1]
    mean = sum(s for s, _ in hosts.values()) / sum(n for _, n in hosts.values())
    a = moments([(s, n, mean) for s, n in hosts.values()])
    of_host = {h: (s + a * mean) / (n + a) for h, (s, n) in hosts.items()}
    b = moments([(s, n, of_host[h]) for (h, _), (s, n) in paths.items()])
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    out = {}
    for i, h, q, e in rows:
        s, n = paths[h, q]
        posterior = (max(s - own[i][0], 0) + b * of_host[h]) / (max(n - own[i][1], 0) + b)
        out[i] = of_host[h], posterior, share(e + logit(posterior) - logit(mean))
    return out


@pytest.mark.parametrize("trust", [0.25, 1.0])
def test_posteriors_against_brute_force(spark, trust):
    docs, labels, _ = corpus(spark)
    got = quality.quality_scores(docs, labels, F.col("site"), F.concat("site", F.lit("/"), F.col("doc_id") % 3), trust=trust).collect()
    given = {r["doc_id"]: r["quality"] for r in labels.collect()}
    want = posteriors([(r["doc_id"], r["host"], r["path"], r["evidence"]) for r in got], given, trust)
    for r in got:
        assert (r["host_quality"], r["path_quality"], r["score"]) == pytest.approx(want[r["doc_id"]], abs=1e-9)


def test_held_out_labels_are_not_used(spark):
    docs, labels, truth = corpus(spark)
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = ({r["doc_id"]: round(r["score"], 12) for r in quality.quality_scores(docs, x, F.col("site"), F.col("site"), held_out=0).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = quality.quality_scores(docs, spark.createDataFrame([(1, 1), (9, 0), (5, 7), (None, 1)], "doc_id long, quality int"), F.col("source"), F.concat("source", "lang"))
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang")).collect()
    assert len(none) == docs.count()
    assert quality.quality_scores(no_docs(spark), spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang")).count() == 0


def test_features():
    x = quality.features(pa.array(["", None, "A!! A!!", "plain words here", "é" * 10]))
    assert x.shape == (5, quality.N_FEATURES) and not x[:2].any() and (x <= 1).all()
