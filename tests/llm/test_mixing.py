import numpy as np
import pytest
from cases import WORD, no_docs, odd_docs, random_docs
from hypothesis import given, settings, strategies as st

from quillon.llm import mixing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
    free = [(t / w) for t, s, w in zip(got, sizes, weights) if t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_subset_sum_is_the_best(histogram, budget):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    got = mixing.subset_sum(lengths, counts, budget)
    sums = {0}
    for n, c in histogram.items():
        sums = {s + k * n for s in sums for k in range(c + 1)}
    assert (got >= 0).all() and (got <= counts).all()
    assert (got * lengths).sum() == max(s for s in sums if s <= budget)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 5000), st.integers(1, 400), min_size=1, max_size=30), st.floats(0, 1), st.sampled_from([64, 4096]))
def test_fit_comes_near(histogram, share, window):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    budget = round(share * int((lengths * counts).sum()))
    got = mixing.fit(lengths, counts, budget, window)
    left = budget - int((got * lengths).sum())
    assert (got >= 0).all() and (got <= counts).all() and left >= 0
    assert left < max(lengths)  # whatever is free and short enough would still fit


def check(docs, got):
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = mixing.targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        own = by[s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert all(r["target"] == pytest.approx(t) for r in own)
        sizes = [r["size"] for r in own if r["size"]]
        assert abs(sum(r["taken"] for r in own) - t) <= max([1, *sizes])
    assert sum(r["target"] for r in {r["source"]: r for r in got}.values()) == pytest.approx(total)


@pytest.mark.parametrize("make", [odd_docs, random_docs])
def test_mix(spark, make):
    docs = make(spark)
    got = mixing.mix(docs).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == want
    check(docs, got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))


def test_mixed_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert out.count() == taken
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= rows


def test_slices_agree(spark):
    docs = random_docs(spark, 300)
    assert sorted(map(repr, mixing.mix(docs, slice_rows=4).select("source", "taken").groupBy("source").sum("taken").collect())) == sorted(map(repr, mixing.mix(docs).select("source", "taken").groupBy("source").sum("taken").collect()))


def test_empty(spark):
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed(no_docs(spark)).count() == 0
