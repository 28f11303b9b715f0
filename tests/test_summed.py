"""Sums of postings for few questions against plain sums; ties with the k-th stay."""

import numpy as np

from quillon.operators import retrieve


def test_best_pairs_keep_the_k_best_so_far_with_ties():
    rng = np.random.default_rng(5)
    score = rng.integers(0, 9, (60, 4)).astype(float)  # many ties
    best, found = np.full((4, 3), -np.inf), []
    for lo in range(0, 60, 7):
        u, q, s, best = retrieve.best_pairs(score[lo : lo + 7], best)
        found += zip((lo + u).tolist(), q.tolist(), s.tolist(), strict=True)
    assert (best == -np.sort(-score, axis=0)[:3].T).all()
    for q in range(4):
        least = best[q, -1]
        assert {(u, s) for u, p, s in found if p == q and s >= least} == {(u, s) for u, s in enumerate(score[:, q]) if s >= least}


def test_nothing_below_or_at_zero_is_found():
    u, q, s, best = retrieve.best_pairs(np.array([[0.0, -1.0], [1e-9, 2.0]]), np.full((2, 1), -np.inf))
    assert (u.tolist(), q.tolist(), s.tolist()) == ([1], [1], [2.0])


def test_summed_against_plain_sums(spark):
    rng = np.random.default_rng(7)
    parts = [(c, c // 3, f"t{t}", float(rng.random())) for c in range(200) for t in rng.choice(12, 4, replace=False)]
    asked = [(q, f"t{t}", int(rng.integers(1, 3))) for q in range(9) for t in rng.choice(14, 5, replace=False)]
    got = retrieve.top_hits(retrieve.summed(spark.createDataFrame(parts, "chunk_id long, passage_id long, term string, part double").repartition(3), spark.createDataFrame(asked, "query_id long, term string, qf long"), 5), 5)
    sums = {}
    for c, p, t, part in parts:
        for q, term, n in asked:
            if term == t:
                sums[q, c, p] = sums.get((q, c, p), 0.0) + n * part
    want = []
    for q in range(9):
        best = sorted((-round(s, 6), p, c) for (a, c, p), s in sums.items() if a == q)[:5]
        want += [(q, c, p, -s, rank + 1) for rank, (s, p, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "passage_id", "score", "rank").collect()) == sorted(want)
