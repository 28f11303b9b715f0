import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCS, lower, no_docs, odd_docs

from quillon.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ([x or "" for x in r] for r in rows):
        terms = TERM.findall(lower(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def weights(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        q = weights(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: weights(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -f, i + 1) for i, (f, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -f, i + 1) for i, (f, t) in enumerate(terms)]
    return sorted(out)


def check(docs, least, top):
    got = divergence.divergence(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()], least, top)
    return rows


@pytest.mark.parametrize("least", [1, 2, 100])
def test_odd_documents(spark, least):
    rows = check(odd_docs(spark), least, 5)
    assert least < 100 or {r[4] for r in rows} == {0}


@pytest.mark.parametrize("held, block", [(600_000, 1 << 20), (10, 16)])
def test_random_sources(spark, monkeypatch, held, block):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = ["a", "B", "né", "ÉÀ", "x1y", "it's", "日本", "zz", "Zz", "_q_"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(300):
        of = int(rng.integers(6))
        chosen = rng.choice(words[of:] if of < 4 else words, rng.integers(0, 40))
        rows.append((i, " ".join(chosen), ["en", "de", None][i % 3], None if of == 5 else f"s{of}", 0))
    check(spark.createDataFrame(rows, DOCS), 12, 50)
    if held == 10:  # tasks hand over their sums again and again; the result is the same
        batch = spark.createDataFrame(rows, DOCS).na.fill("").select("lang", "source", "text").toArrow().to_batches()
        parts = list(divergence.count_rows(iter(batch)))
        assert len(parts) > 5 and sum(sum(p.column("n").to_pylist()) for p in parts) == sum(len(TERM.findall(r[1])) for r in rows)


def test_exact_arithmetic(spark):
    big = spark.createDataFrame([(3_000_000_000_000, 7_000_000_000_001, 3)], "n long, total long, kept long")
    n, total, kept = big.first()
    assert big.select(divergence.weight(*[big[c] for c in ("n", "total", "kept")])).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_empty_table(spark):
    assert divergence.divergence(no_docs(spark)).collect() == []
