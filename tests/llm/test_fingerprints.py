import hashlib
import re
from collections import deque

import pytest
import xxhash
from cases import no_docs, odd_docs, random_docs

from quillon.llm import fingerprints as fp


def rolled(text, k):
    """The rolling hash of each k-gram, one after the other."""
    s = [xxhash.xxh64_intdigest(c.encode(), 42) for c in text] + [0] * max(0, k - len(text))
    h, full = 0, (1 << 64) - 1
    for x in s[:k]:
        h = (h << 1 ^ x) & full
    out = [h]
    for first, after in zip(s, s[k:]):
        h = (h << 1 ^ first << k ^ after) & full
        out.append(h)
    return [x >> 21 for x in out]


def brute(text, k=12, window=12):
    if not text:
        return []
    h = rolled(text, k)
    window = min(window, len(h))
    out, best = [], deque()
    for i, v in enumerate(h):
        while best and h[best[-1]] >= v:
            best.pop()
        best.append(i)
        if best[0] <= i - window:
            best.popleft()
        if i >= window - 1 and (not out or out[-1][1] != best[0]):
            out.append((h[best[0]], best[0]))
    return out


def dice(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("block", [16384, 50])
@pytest.mark.parametrize("make", [odd_docs, random_docs])
def test_against_brute_force(spark, make, block, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", block)
    docs = make(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 63) ^ -(1 << 63)
    order = sorted(((i, t) for i, t in rows if i is not None), key=lambda x: (x[0], signed(x[1])))
    want = []
    for x, (i, text) in enumerate(order):
        want.append((i, text, order[(x + 1) % len(order)][1]))
    want += [(None, t, "") for i, t in rows if i is None]
    expected = []
    for i, text, follows in want:
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follows[:cut]
        a, b, c = brute(text), brute(edited), brute(follows)
        as_text = lambda prints: ",".join(f"{h:X}:{p}" for h, p in prints)
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), round(dice(a, b), 9), round(dice(a, c) if i is not None else dice(a, []), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.fingerprint_texts(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("k", "window", "block"), [(3, 2, 7), (5, 4, 16384), (12, 12, 100)])
def test_other_sizes(spark, k, window, block, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", block)
    docs = random_docs(spark, 40).where("length(text) < 3000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in fp.fingerprint(docs, k, window).collect():
        assert [tuple(x) for x in r["prints"]] == brute(texts[r["doc_id"]], k, window)


def test_generated_code_is_compiled(spark):
    """The JVM compiles no method above 8000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = fp.fingerprint(random_docs(spark, 5))._jdf.queryExecution().executedPlan()
    spark.conf.unset("spark.sql.adaptive.enabled")
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert len(sizes) > 2 and max(sizes) < 8000, sizes


def test_shared_passages_are_found(spark):
    passage = "a passage of more than twenty-three code points"
    rows = [(1, "left " * 9 + passage + " right" * 7), (2, "ZZZ " * 30 + passage + "!")]
    a, b = ({h for h, _ in brute(t)} for _, t in rows)
    assert a & b
    got = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.fingerprint(got).collect()
    assert {x["hash"] for x in got[0]["prints"]} & {x["hash"] for x in got[1]["prints"]}


def test_rightmost_of_ties(spark):
    got = fp.fingerprint(spark.createDataFrame([(1, "ab" * 40)], "doc_id long, text string")).first()["prints"]
    assert [tuple(x) for x in got] == brute("ab" * 40)


def test_native_and_repeated_rows(spark):
    docs = odd_docs(spark)
    made = fp.fingerprints(docs)
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())
    rows = made.collect()
    assert len(rows) == docs.count() and sum(r["doc_id"] == 15 for r in rows) == 2
    assert all(r["near_next"] == 0 for r in rows if r["doc_id"] is None)


def test_empty_and_single(spark):
    assert fp.fingerprints(no_docs(spark)).count() == 0
    only = fp.fingerprints(spark.createDataFrame([(1, "one text alone, which follows itself")], "doc_id long, text string")).first()
    assert only["near_next"] == 1.0
