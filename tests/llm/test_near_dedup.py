import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, WORD, lower, no_docs, odd_docs, prose, random_docs

from quillon.llm import graph, near_dedup, textvec


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, threshold=85):
    """{doc_id: (set size, smallest linked doc_id)} over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                a_, b_ = sorted((root(i), root(j)))
                up[b_] = a_
    return {i: root(i) for i, _ in sets}


@pytest.mark.parametrize("options", [{}, {"sketch_block": 4, "block": 3}])
def test_against_all_pairs(spark, options):
    docs = random_docs(spark)
    got = near_dedup.near_dedup(docs, **options).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = prose(rng, 150).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(len(w))] = f"edit{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), sketch_block=16, block=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == docs.count()
    of = {r["doc_id"]: r for r in got}
    assert of[1]["component_id"] == of[2]["component_id"] == of[3]["component_id"] == of[4]["component_id"] == 1
    assert [of[i]["component_id"] for i in (6, 7, 8)] == [6, 7, 8] and of[6]["n_shingles"] == 0 and of[6]["kept"]
    assert of[10]["component_id"] == 9 and of[11]["component_id"] == 11
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = near_dedup.near_dedup_keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_empty(spark):
    assert near_dedup.near_dedup(no_docs(spark)).count() == 0 and near_dedup.near_dedup_keep(no_docs(spark)).count() == 0


def test_words_match_the_pattern():
    texts = ["A b\tC", "", None, " x ", "é É\x0b\x00y", "a", "b" * 3000 + " c", "\x85\xa0 z"]
    h, at = textvec.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = WORD.findall(lower(t or ""))
        assert at[i + 1] - at[i] == len(own)
        for w, v in zip(own, h[at[i] : at[i + 1]], strict=True):
            assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)
    part, begin = textvec.words(pa.array(texts).slice(3, 2))
    assert (part == h[at[3] : at[5]]).all() and begin[-1] == len(part)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 20, 200, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 2**63, n // 5, dtype=np.uint64)])
        value, at = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n, 2 * n])
        s = textvec.sketches(value, at, 640)
        assert (s[2] == s[2][0]).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - true) < 0.1


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4200)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_words_that_collide_as_polynomials(spark):
    """Two words of 1024 letters at which every polynomial modulo 2**64 agrees share nothing."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = near_dedup.near_dedup(spark.createDataFrame([(1, a, "", "", 0), (2, b, "", "", 0)], DOCS)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(1, 1, True), (2, 2, True)]
