import hashlib
import re

import pytest
from cases import no_docs, odd_docs, random_docs

from quillon.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for n, own in groups.items():
        best = min(own)
        for nth, row in enumerate(sorted(own)):
            out.append((None if row[1] else row[2], None if best[1] else best[2], len(own), nth == 0, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [odd_docs, random_docs])
@pytest.mark.parametrize("options", [{}, {"max_depth": 3, "capacity": 5}])
def test_against_brute_force(spark, make, options):
    docs = make(spark)
    got = exact_dedup.exact_dedup(docs, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    kept = exact_dedup.exact_dedup_keep(docs, **options)
    assert kept.columns == docs.columns
    sha = lambda t: hashlib.sha256(norm(t).encode()).hexdigest()
    assert sorted(((r["doc_id"], sha(r["text"])) for r in kept.collect()), key=repr) == sorted(((x[0], x[4]) for x in want if x[3]), key=repr)


def test_directory_doubles_and_splits():
    counts = {0: 50, 1: 1, 2: 1, 3: 1, 6: 9, 7: 9}
    made = exact_dedup.directory(counts, 3, 10)
    assert sum(w for _, w, _, _ in made) == 8 and [f for f, *_ in made] == sorted(f for f, *_ in made)
    for first, width, depth, pages in made:
        rows = sum(counts.get(p, 0) for p in range(first, first + width))
        assert width == 1 << (3 - depth) and (rows <= 10 or depth == 3) and pages == max(1, -(-rows // 10))
    assert exact_dedup.directory({}, 4, 10) == [(0, 16, 0, 1)]


def test_collisions_are_chained(spark):
    docs = spark.createDataFrame([(i, f"text {i % 4}") for i in range(40)], "doc_id long, text string")
    chains, _, index = exact_dedup.exact_groups(docs, 2, 3)
    assert chains.count() == 4 and {r["slot"] for r in chains.collect()} == {1}
    assert sum(r["n_rows"] for r in index.collect()) == 40


def test_colliding_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    keyed = exact_dedup.keyed
    monkeypatch.setattr(exact_dedup, "keyed", lambda docs: keyed(docs).withColumn("key", F.length("norm").cast("long") % 2))
    docs = random_docs(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    slots = {}
    for r in exact_dedup.exact_groups(docs, 2, 3)[0].collect():
        slots.setdefault(r["key"], []).append(r["slot"])
    assert max(map(len, slots.values())) > 1 and all(sorted(s) == list(range(1, len(s) + 1)) for s in slots.values())
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, 2, 3).collect()), key=repr) == want


def test_the_largest_id_is_an_id(spark):
    for ids in ([2**63 - 1], [2**63 - 1, None], [-(2**63), 0, None]):
        docs = spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string")
        want = brute([(i, "same") for i in ids])
        assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=repr) == want
        assert [r["doc_id"] for r in exact_dedup.exact_dedup_keep(docs.withColumn("__key", docs["text"])).collect()] == [ids[0]]


def test_a_hot_group_is_looked_up_on_its_pages(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('text ', id)) as text")
    chains, rows, _ = exact_dedup.exact_groups(docs, 4, 16)
    pages = rows.where("doc_id % 3 = 0").groupBy("bucket", "page").count().collect()
    assert len(pages) > 5 and max(r["count"] for r in pages) < 100
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, 4, 16).collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_native(spark):
    plan = exact_dedup.exact_dedup(random_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert exact_dedup.exact_dedup(no_docs(spark)).count() == 0 and exact_dedup.exact_dedup_keep(no_docs(spark)).count() == 0
