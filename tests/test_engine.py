"""Chunkers, ranking, metrics and the pipeline by their rules and invariants."""

import pytest
from conftest import rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillon.config import RetrievalConfig, matrix, validated_question
from quillon.operators import chunking, metrics, ranking, relations
from quillon.plans import QUERIES, evaluation
from quillon.plans.engine import Engine
from quillon.sources import tables


def spans(df):
    return [(r["char_start"], r["char_end"]) for r in df.orderBy("passage_id", "chunk_index").collect()]


def passages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")


def test_fixed_windows(spark):
    words = [f"w{i}" for i in range(300)]
    got = spans(chunking.fixed(passages(spark, " ".join(words))))
    text = " ".join(words)
    assert [text[s:e].split(" ") for s, e in got] == [words[0:128], words[96:224], words[192:300]]
    assert spans(chunking.fixed(passages(spark, " ".join(words[:128])))) == [(0, len(" ".join(words[:128])))]


def test_sentence_merge(spark):
    sentence = lambda n: "A" + " b" * (n - 2) + "."  # noqa: E731  n tokens with the full stop
    text = " ".join(sentence(n) for n in (3, 20, 4, 5, 10))
    sizes = [r["n_tokens"] for r in chunking.sentence(passages(spark, text)).orderBy("chunk_index").collect()]
    assert sizes == [3, 29, 10]


def test_chunks_cover_and_lie_in_the_text(spark, sf):
    p = tables.passages(spark, sf).where("passage_id % 4 = 1")
    lengths = {r["passage_id"]: r["text"] for r in p.collect()}
    for name in chunking.DEFAULT_STRATEGIES:
        rows = chunking.chunker(name, 0.9)(p).orderBy("passage_id", "chunk_index").collect()
        by = {}
        for r in rows:
            by.setdefault(r["passage_id"], []).append(r)
        assert set(by) == set(lengths)
        for i, own in by.items():
            text = lengths[i]
            assert [r["chunk_index"] for r in own] == list(range(len(own)))
            covered = set()
            for r in own:
                assert 0 <= r["char_start"] < r["char_end"] <= len(text)
                body = text[r["char_start"] : r["char_end"]]
                assert body == body.strip()
                covered |= set(range(r["char_start"], r["char_end"]))
            assert all(text[k].isspace() for k in set(range(len(text))) - covered), name


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. ,;?!", max_size=200), st.integers(2, 12))
def test_recursive_split(text, size):
    text = " ".join(text.split())
    got = chunking.split_spans(text, size, size // 3, lambda t: len(t.split()))
    assert all(len(text[s:e].split()) <= size for s, e in got)
    covered = {i for s, e in got for i in range(s, e)}
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)


def test_semantic_breaks(spark):
    sentence = lambda words: " ".join(words).capitalize() + "."
    a, b = ["alpha", "beta", "gamma", "delta", "alpha", "eta"], ["one", "two", "three", "four", "five", "six"]
    text = " ".join([sentence(a), sentence(a), sentence(b)])
    assert len(spans(chunking.semantic(passages(spark, text), 0.5))) == 2
    assert len(spans(chunking.semantic(passages(spark, text), 0.5, most=7))) == 3


def test_unknown_chunker():
    with pytest.raises(ValueError, match="no chunker"):
        chunking.chunker("other")


def hits(spark, *lists):
    return spark.createDataFrame([(1, c, c, r) for r, c in enumerate(lists, 1)], "query_id long, chunk_id long, passage_id long, rank int")


def test_rrf(spark):
    a, b, c = 10, 20, 30
    got = ranking.rrf({"dense": hits(spark, a, b), "bm25": hits(spark, b, c)}).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in got] == [(b, 0.032522), (a, 0.016393), (c, 0.016129)]
    assert [r["chunk_id"] for r in ranking.rrf({"dense": hits(spark, a), "bm25": hits(spark, b)}).orderBy("rank").collect()] == [a, b]
    assert [r["chunk_id"] for r in ranking.rrf({"one": hits(spark, c, a, b)}).orderBy("rank").collect()] == [c, a, b]


def test_metrics(spark):
    rows = [(1, i, p, i) for i, p in enumerate([9, 1, 2, 2, 8], 1)]
    found = spark.createDataFrame(rows, "query_id long, chunk_id long, passage_id long, rank int")
    gold = spark.createDataFrame([(1, p) for p in (1, 2, 5)], "query_id long, passage_id long")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r for r in metrics.question_metrics(found, gold, asked).collect()}
    assert (got[1]["mrr"], got[1]["recall_3"], got[1]["precision_5"], got[1]["ndcg_3"], got[1]["n_passages"]) == (0.5, 0.666667, 0.4, 0.530721, 4)
    assert got[2]["n_gold"] == 0 and got[2]["mrr"] is None and got[2]["recall_10"] is None


@pytest.mark.parametrize(
    ("n_gold", "at", "want"),
    [
        (18, (1, 2, 3, 4, 5, 7), {"mrr": 1.0, "recall_10": 0.333333, "precision_10": 0.6, "precision_20": 0.3, "ndcg_3": 1.0, "ndcg_10": 0.722295, "ndcg_20": 0.49866}),
        (8, (1, 2, 4, 5, 6, 7), {"mrr": 1.0, "recall_3": 0.25, "recall_5": 0.5, "recall_10": 0.75, "ndcg_3": 0.765361, "ndcg_5": 0.83042, "ndcg_10": 0.793734}),
    ],
)
def test_golden_metrics(spark, n_gold, at, want):
    found = spark.createDataFrame([(1, r, r if r in at else 1000 + r, r) for r in range(1, 11)], "query_id long, chunk_id long, passage_id long, rank int")
    gold = spark.createDataFrame([(1, p) for p in [*at, *range(500, 500 + n_gold - len(at))]], "query_id long, passage_id long")
    got = metrics.question_metrics(found, gold, spark.createDataFrame([(1,)], "query_id long")).first()
    assert {k: round(got[k], 6) for k in want} == want


def test_labels():
    config = RetrievalConfig("sentence", "hybrid", "decompose", True, "window")
    assert config.label == "sentence+hybrid+decompose+rerank+window" and config.depth == 20 and RetrievalConfig().depth == 5
    for c in matrix(chunking.DEFAULT_STRATEGIES, ("bm25", "kg"), ("none", "hyde"), (False, True), ("none", "parent")):
        assert RetrievalConfig.parse(c.label) == c
    for bad in ({"retriever": "x"}, {"top_k": 21}, {"candidate_k": 0}, {"expansion": "all"}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)
    with pytest.raises(ValueError):
        validated_question("x")


def test_subsample(spark):
    ids = spark.range(100).toDF("id")
    safe, gold = spark.range(10).toDF("id"), spark.range(10, 40).toDF("id")
    kept = {r["id"] for r in relations.subsample(ids, safe, gold, 50).collect()}
    assert len(kept) == 50 and set(range(10)) <= kept and len(kept & set(range(10, 40))) >= 20
    assert relations.subsample(ids, safe, gold, 100).count() == 100


def test_engine(spark, sf):
    engine = Engine(spark, sf)
    asked = tables.questions(spark, sf).where("query_id < 5")
    for label in ("passage+dense", "sentence+hybrid", "passage+bm25+multi_query", "passage+grep", "passage+kg", "sentence+bm25+rerank+parent"):
        config = RetrievalConfig.parse(label)
        got = engine.retrieve(asked, config)
        rows = got.collect()
        by = {}
        for r in rows:
            by.setdefault(r["query_id"], []).append(r["rank"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 10 for v in by.values()), label
        context = engine.with_context(got, config)
        assert {r["passage_id"] for r in context.collect()} == {r["passage_id"] for r in rows}
    first = engine.evaluate(matrix(("passage",), ("bm25", "dense"))).collect()
    assert {r["config"] for r in first} == {"passage+bm25", "passage+dense"} and all(0 <= r["mrr"] <= 1 for r in first)


def test_sinks(spark, tmp_path):
    rows = spark.range(4).withColumn("strategy", F.when(F.col("id") < 2, "a").otherwise("b"))
    at = str(tmp_path / "chunks")
    tables.write_partitioned(rows, at, "strategy")
    tables.write_partitioned(rows.limit(0), at, "strategy")
    assert spark.read.parquet(at).count() == 4
    tables.write_partitioned(rows.where("id = 0"), at, "strategy", replace=True)
    assert spark.read.parquet(at).count() == 3


def test_latency_stream(spark, sf, tmp_path):
    from quillon.streaming.latency import latency, stream

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    query = latency(stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("latency_rows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("latency_rows").collect())) == sorted(map(tuple, latency(batch).collect()))


def test_dense_asks_every_hundredth(spark, sf):
    ids = {r["vec_id"] for r in tables.read(spark, sf, "embeddings").where("vec_id % 100 = 0").collect()}
    for name in ("dense_topk", "dense_label_precision"):
        assert {r["query_id"] for r in QUERIES[name](spark, sf).collect()} == ids


def test_all_strategies_are_scored_and_counted(spark, sf, monkeypatch):
    for name in ("chunk_stats_default", "built_strategies_default", "explore_passage_default"):
        assert {r["strategy"] for r in QUERIES[name](spark, sf).select("strategy").collect()} == set(chunking.DEFAULT_STRATEGIES)
    old = {r["strategy"]: r.asDict() for r in QUERIES["chunk_stats"](spark, sf).collect()}
    new = {r["strategy"]: r.asDict() for r in QUERIES["chunk_stats_default"](spark, sf).collect()}
    assert all(new[s] == r for s, r in old.items())
    got = Engine(spark, sf).evaluate(matrix(("recursive_128_32", "semantic"), ("bm25",))).collect()
    assert {r["config"] for r in got} == {"recursive_128_32+bm25", "semantic+bm25"} and all(0 <= r["mrr"] <= 1 and r["errors"] == 0 for r in got)
    monkeypatch.setattr(Engine, "evaluate", lambda self, configs: configs)
    assert {c.strategy for c in QUERIES["eval_matrix"](spark, sf)} == set(chunking.DEFAULT_STRATEGIES) and len(QUERIES["eval_matrix"](spark, sf)) == 25


def test_whole_texts_are_trimmed(spark, sf):
    ends = QUERIES["trim_spans"](spark, sf).groupBy("doc_id").agg(F.max("e").alias("e"))
    texts = tables.read(spark, sf, "documents").where("length(text) > 400 and rtrim(text) = text").select("doc_id", F.length("text").alias("n"))
    rows = texts.join(ends, "doc_id", "left").collect()
    assert rows and all(r["e"] == r["n"] for r in rows)


def test_store_is_keyed_by_content(spark, tmp_path):
    from quillon.sources.store import Store, content_key

    p = passages(spark, "One two three. Four five.", "Two six seven eight nine ten.")
    kept, built = Store(p, f"file://{tmp_path}"), []
    make = lambda: built.append(1) or p.select("passage_id")
    assert kept.table("ids", make).count() == 2 and Store(p, f"file://{tmp_path}").table("ids", make).count() == 2 and len(built) == 1
    edited = passages(spark, "One two three. Four five!", "Two six seven eight nine ten.")  # as many rows
    assert content_key(edited) != kept.key
    Store(edited, f"file://{tmp_path}").table("ids", make)
    assert len(built) == 2
    lexical = kept.lexical("passage")
    assert {r["term"]: r["df"] for r in lexical.df.collect()}["two"] == 2
    assert lexical.stats.first()["n"] == 2 and lexical.found(spark.createDataFrame([("two",)], "term string")).where("term = 'two'").count() == 2


def test_indexed_retrieval_is_the_same_as_over_texts(spark, sf, monkeypatch):
    from quillon.operators import retrieve
    from quillon.plans.retrieval import sentence_units

    asked, p = tables.questions(spark, sf), tables.passages(spark, sf)
    over = {tuple(r) for r in retrieve.bm25(asked, sentence_units(p)).select("query_id", "chunk_id", "score", "rank").collect()}
    kept = tables.store(spark, sf).lexical("sentence")
    assert {tuple(r) for r in retrieve.bm25_indexed(asked, kept).select("query_id", "chunk_id", "score", "rank").collect()} == over
    monkeypatch.setattr(retrieve, "few", lambda questions, most=0: False)  # as with very many questions
    assert {tuple(r) for r in retrieve.bm25_indexed(asked, kept).select("query_id", "chunk_id", "score", "rank").collect()} == over
    vectors = tables.read(spark, sf, "embeddings").selectExpr("vec_id as chunk_id", "vec_id as passage_id", "embedding")
    queries = vectors.where("chunk_id % 100 = 0").selectExpr("chunk_id as query_id", "embedding as query_vec")
    few, many = ({tuple(r) for r in retrieve.dense(queries, vectors, 5, most=m).select("query_id", "chunk_id", "rank").collect()} for m in (20_000, 0))
    assert few == many


def test_gold_by_words_is_gold_by_containment(spark, sf):
    p = passages(spark, "xx alpha beta gamma delta eps zetayy", "alpha beta gamma delta eps", "a b", "none")
    asked = spark.createDataFrame([(1, "pha beta gamma delta eps zeta"), (2, "a b"), (3, "alpha beta gamma delta eps"), (4, "x alpha beta gamma delta eps zeta")], "query_id long, query_text string")
    assert sorted(map(tuple, tables.qrels(asked, p).collect())) == [(1, 0), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (4, 0)]
    asked, p = tables.questions(spark, sf), tables.passages(spark, sf)
    want = p.crossJoin(asked).where(F.contains("text", F.col("query_text"))).select("query_id", "passage_id")
    assert sorted(map(tuple, tables.qrels(asked, p).collect())) == sorted(map(tuple, want.collect()))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), min_size=1, max_size=12))
def test_display_rows(spark, spans):
    from quillon.operators import layers

    spans = sorted((s, s + n) for s, n in spans)
    got = layers.display_rows(spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(spans)], "passage_id long, chunk_index int, char_start int, char_end int")).collect()
    rows: list[list] = []
    want = []
    for s, e in spans:
        free = next((i for i, r in enumerate(rows) if all(s >= b or e <= a for a, b in r)), None)
        if free is None:
            rows.append([])
            free = len(rows) - 1
        rows[free].append((s, e))
        want.append(free)
    assert [r["display_row"] for r in sorted(got, key=lambda r: r["chunk_index"])] == want


def test_runs(spark, sf, tmp_path):
    import json

    from quillon.plans import runs
    from quillon.sources import schema

    root = f"file://{tmp_path}/eval"
    schema.apply(spark, root)
    asked = tables.questions(spark, sf).where("query_id < 4")
    fails = {"dense": lambda q, s, k: spark.read.parquet("file:///nowhere")}
    engine = Engine(spark, sf, retrievers=fails)
    small = runs.evaluate(engine, matrix(("passage",), ("bm25",)), root, "small", questions=asked)
    run = runs.evaluate(engine, matrix(("passage", "sentence"), ("bm25", "dense")), root, "matrix", questions=asked)
    heads = {r["id"]: r for r in runs.listed(spark, root, "retrieval").collect()}
    assert set(heads) == {small, run} and all(r["status"] == "done" and r["finished_at"] for r in heads.values())
    assert runs.largest_retrieval(spark, root).first()["id"] == run and runs.listed(spark, root, "other").count() == 0
    summary = json.loads((tmp_path / "eval/eval_runs" / run / "summary.json").read_text())
    by = {c["config"]: c for c in summary["configs"]}
    assert by["passage+dense"]["errors"] == 4 and by["passage+bm25"]["errors"] == 0 and by["passage+dense"]["mrr"] in (0.0, None) and by["passage+bm25"]["seconds"] > 0
    assert (tmp_path / "eval/eval_runs" / run / "report.md").read_text().count("\n| ") >= 6
    assert len((tmp_path / "eval/eval_runs" / run / "per_config.csv").read_text().splitlines()) == 5
    assert spark.read.option("header", True).csv(f"{root}/eval_runs/{run}/per_question.csv").count() == 16
    results = runs.results_of(spark, root, run, asked)
    assert results.count() == 16 and results.where("error is not null").count() == 8 and results.where("question is null").count() == 0
    assert schema.read(spark, root, "query_logs").where("source = 'eval' and id is not null and created_at is not null").count() == 20
    assert {r["name"]: r["n_rows"] for r in schema.catalog(spark, root).collect() if r["name"] in ("query_logs", "passages")} == {"query_logs": 20, "passages": 0}
    assert runs.write_eval_set(spark, spark.range(3), f"{root}/set.json") == 3 and json.loads((tmp_path / "eval/set.json").read_text())[2]["id"] == 2


def test_a_failure_is_no_result(spark, sf, monkeypatch):
    """A board with a retriever that fails is not a board of zeros, and an evaluation that notes errors gives no metrics for them."""
    fails = {"dense": lambda q, s, k: spark.read.parquet("file:///nowhere")}
    two = matrix(("passage",), ("dense", "bm25"))
    with pytest.raises(Exception, match="nowhere"):
        Engine(spark, sf, retrievers=fails).evaluate(two)
    by = {r["config"]: r for r in Engine(spark, sf, retrievers=fails).evaluate(two, noted=True).collect()}
    assert by["passage+dense"]["mrr"] is None and by["passage+dense"]["recall_10"] is None and "nowhere" in by["passage+dense"]["error"] and by["passage+dense"]["errors"] > 0
    assert by["passage+bm25"]["mrr"] > 0 and by["passage+bm25"]["error"] is None
    monkeypatch.setattr(evaluation, "term_dense", lambda *_: fails)
    monkeypatch.setattr(evaluation, "BOARD_RETRIEVERS", ("dense",))
    with pytest.raises(Exception, match="nowhere"):
        QUERIES["leaderboard"](spark, sf)


def test_schemas_and_log(spark, tmp_path):
    from quillon.sources import schema

    root = f"file://{tmp_path}/db"
    assert set(schema.apply(spark, root)) == set(schema.SCHEMAS) and schema.apply(spark, root) == []
    rows = spark.createDataFrame([(1, "q one", "eval", [(7, "long text")]), (2, "q two", "api", [(8, "kept")])], "query_id long, question string, source string, retrieved array<struct<passage_id:long,text:string>>")
    assert schema.append_log(rows, f"{root}/query_logs") and schema.append_log(rows.limit(1), f"{root}/query_logs")
    log = schema.read(spark, root, "query_logs")
    assert len(log.columns) == 17 and log.count() == 3 and log.select("id").distinct().count() == 3
    assert {r["question"]: r["retrieved"] for r in log.collect()} == {"q one": '[{"passage_id":7}]', "q two": '[{"passage_id":8,"text":"kept"}]'}
    assert not schema.append_log(rows, "file:///proc/nowhere/log")
    with pytest.raises(Exception):
        schema.append_log(rows, "file:///proc/nowhere/log", strict=True)
    assert schema.load_once(spark, spark.range(3), f"{root}/once") and not schema.load_once(spark, spark.range(9), f"{root}/once")
    assert schema.load_once(spark, spark.range(9), f"{root}/once", replace=True) and spark.read.parquet(f"{root}/once").count() == 9
    assert schema.apply(spark, root, reset=True) and schema.read(spark, root, "query_logs").count() == 0


def test_settings():
    from quillon.settings import Settings

    assert Settings.load({}).top_k == 5 and Settings.load({"QUILLON_TOP_K": "7", "QUILLON_BM25_B": "0.5"}) == Settings(top_k=7, bm25_b=0.5)


def test_settings_reach_the_retrievers(spark, sf):
    from quillon.operators import retrieve
    from quillon.settings import Settings

    asked = tables.questions(spark, sf).where("query_id < 6")
    engine = Engine(spark, sf, settings=Settings(strategy="passage", retriever="bm25", top_k=3, bm25_k1=0.5, bm25_b=0.0, grep_candidates=2, rrf_constant=1, graph_candidates=4, graph_neighbours=1))
    hits = lambda name: engine.retrieve(asked, RetrievalConfig("passage", name, top_k=5))
    want = retrieve.bm25_indexed(asked, engine.store.lexical("passage"), 5, 0.5, 0.0)
    assert sorted(map(tuple, hits("bm25").collect())) == sorted(map(tuple, want.select(hits("bm25").columns).collect()))
    assert max(r["rank"] for r in hits("grep").collect()) <= 2 and max(r["rank"] for r in hits("kg").collect()) <= 5
    assert max(r["score"] for r in hits("hybrid").collect()) > 0.3
    assert engine.default_config() == RetrievalConfig("passage", "bm25", top_k=3) and engine.embedding == "hashed_64"
    assert max(len(r["passages"] or []) for r in engine.ask(asked).collect()) == 3


def test_providers(spark, sf):
    from quillon.functions import vectors

    asked = tables.questions(spark, sf).where("query_id < 4")
    engine = Engine(spark, sf, score=vectors.pair_scorer(lambda pairs: [float(len(t)) for _, t in pairs]))
    got = engine.retrieve(asked, RetrievalConfig.parse("passage+bm25+rerank", top_k=3)).collect()
    assert got and all(a["score"] >= b["score"] for a in got for b in got if a["query_id"] == b["query_id"] and a["rank"] < b["rank"])
    judged = engine.judged(spark.createDataFrame([(1, "alpha beta")], "query_id long, answer string"), spark.createDataFrame([(1, "beta gamma")], "query_id long, text string"))
    assert judged.first()["judgement"] == 0.5


def test_every_nth(spark):
    p = spark.range(100).selectExpr("id * 7 as passage_id", "'x' as text")
    got = sorted(r["passage_id"] for r in chunking.every_nth(p, 30).collect())
    assert got == [7 * 3 * i for i in range(30)]
    assert chunking.every_nth(p, 1000).count() == 100 and chunking.every_nth(p.limit(0)).count() == 0


def test_token_windows(spark):
    def plain(text, size, overlap):
        import regex

        starts, at = [], 0
        for m in regex.finditer(r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])", text):
            starts.append(m.start())
        offsets = [*starts, len(text)]
        n = len(starts)
        if n <= size:
            return [(0, len(text))]
        out, at = [], 0
        while at < n:
            end = min(at + size, n)
            s, e = offsets[at], offsets[end]
            while s > 0 and not text[s - 1].isspace():
                s -= 1
            while e < len(text) and not text[e].isspace():
                e += 1
            body = text[s:e]
            out.append((s + len(body) - len(body.lstrip()), e - len(body) + len(body.rstrip())))
            if end == n:
                break
            at += size - overlap
        return out

    text = "one-two, three (four) five. six seven-eight-nine ten a,b,c,d,e eleven twelve"
    for size, overlap in ((4, 1), (5, 3), (7, 0), (100, 5)):
        assert spans(chunking.tokens(passages(spark, text), size, overlap)) == plain(text, size, overlap)


def test_three_transforms_ask_differently(spark):
    from quillon.operators import layers

    asked = spark.createDataFrame([(1, "what binds the red ligand, and which gene makes receptor alpha?"), (2, "one thing"), (3, "")], "query_id long, query_text string")
    got = {(r["query_id"], r["nth"]): r["query_text"] for r in layers.clauses(asked).collect()}
    assert got == {(1, 0): "what binds the red ligand, and which gene makes receptor alpha?", (1, 1): "what binds the red ligand", (1, 2): "which gene makes receptor alpha", (2, 0): "one thing", (3, 0): ""}
    hits = spark.createDataFrame([(1, 7, 3.0, "ligand ligand receptor pathway", 1), (1, 8, 1.0, "pathway other", 2)], "query_id long, chunk_id long, score double, text string, rank int")
    model = {r["term"]: r["weight"] for r in layers.relevance_model(asked.where("query_id = 1"), hits, 20).collect()}
    tokens = ["what", "binds", "red", "ligand", "which", "gene", "makes", "receptor", "alpha"]
    n = len(tokens)
    want = {t: 0.5 / n for t in tokens}
    for term, x in (("ligand", 0.5 * 0.75 * 2 / 4), ("receptor", 0.5 * 0.75 / 4), ("pathway", 0.5 * (0.75 / 4 + 0.25 / 2)), ("other", 0.5 * 0.25 / 2)):
        want[term] = want.get(term, 0) + x
    assert model == {t: round(w, 9) for t, w in want.items()}
    hyde = {r["nth"]: r["query_text"] for r in layers.hypothetical(asked.where("query_id = 1"), hits, 3).collect()}
    assert hyde == {0: asked.first()["query_text"], 1: "ligand pathway receptor"}


def test_only_the_passages_of_hits_are_cut(spark, sf):
    """The text of hits' chunks, equal to that of all chunks, of which others are not made."""
    engine, asked = Engine(spark, sf), tables.questions(spark, sf)
    for strategy in ("passage", "sentence"):
        hits = engine._lexical(asked, strategy, 3).cache()
        got = engine.text_of(asked, hits, strategy)
        assert set(rows_of(got)) == set(rows_of(engine.units(strategy).select("chunk_id", "text").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")))
        assert got.count() == hits.select("chunk_id").distinct().count()
