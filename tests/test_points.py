"""Work on whole batches of code points against the native expressions and by hand."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import points
from quillon.functions import text as tx
from quillon.functions import vectors
from quillon.operators import chunking, index, retrieve
from quillon.plans import evaluation
from quillon.sources import tables
from quillon.sources.files import listed
from quillon.sources.store import Store

ODD = ["", " ", "A. B", "Hi there. You (x). [ok] É. Z 9! 1 a.", "x", "Ünïcödé \U0001d400\U0001d400. \U0001d400 A. Bb ١٢ ½ x_y a-b'c", "áb. C", ". . A ! 9", "İstanbul ΣΑΣ. İ", None]
ODD += ["", "one. Two three four five six seven eight. Nine ten", "of the. And The of to in it"] + [" ".join("w%d." % i for i in range(n)) for n in (95, 96, 97, 128, 129, 224, 225, 321)]


def passages(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "passage_id long, text string").repartition(1)  # all in one batch


def test_classes_are_those_of_the_expressions(spark):
    cps = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    rows = cps.where(~F.rlike("c", F.lit(r"\p{Cn}"))).select("id", F.rlike("c", F.lit(r"[\p{L}\p{N}]")).alias("letter"), F.rlike("c", F.lit(r"\s")).alias("blank")).toArrow()
    got = points.classes()[rows["id"].to_numpy()]
    assert ((got == points.LETTER) == rows["letter"].to_numpy()).all() and ((got == points.BLANK) == rows["blank"].to_numpy()).all()


def test_parts_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(points, "PART", 5)
    texts = ["abc", "de", None, "", "f" * 9, "g", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["passage_id", "text"])
    got = list(points.parts(batch))
    assert [t for _, part in got for t in part] == ["abc", "de", "", "f" * 9, "g", ""]
    assert [p for rows, _ in got for p in rows.column("passage_id").to_pylist()] == [0, 1, 3, 4, 5, 6] and max(len(part) for _, part in got) < 6


def test_chunkers_are_those_of_each_text_alone(spark):
    """What a text's chunks are does not depend on its neighbours in a batch."""
    for name in ("sentence", "fixed_128_32", "fixed_3_1"):
        got = sorted(tuple(r) for r in chunking.chunker(name)(passages(spark)).drop("chunk_id", "strategy").collect())
        alone = []
        for i, text in enumerate(ODD):
            if text is None:
                continue
            cps, starts = points.points([text])
            before = points.tokens_before(cps, starts)
            cut = chunking.joined_sentences(6) if name == "sentence" else chunking.word_windows(*map(int, name.split("_")[1:]))
            alone += [(i, j, int(s), int(e), int(before[e] - before[s])) for j, (s, e) in enumerate(zip(*cut(cps, starts, before)[1:]))]
        assert got == alone


def test_sentences_are_those_of_the_pattern(spark):
    own = passages(spark).where("text is not null")
    got = {r["passage_id"]: r["all"] for r in own.select("passage_id", tx.sentences(F.col("text")).alias("all")).collect()}
    for i, text in enumerate(ODD):
        if text is not None and text != " ":
            _, s, e = chunking.sentence_spans(*points.points([text]))
            assert [text[a:b] for a, b in zip(s, e)] == got[i]
    counts = {r[0]: r[1] for r in own.select("passage_id", tx.n_tokens(F.col("text"))).collect()}
    cps, starts = points.points([t for t in ODD if t is not None])
    assert np.diff(points.tokens_before(cps, starts)[starts]).tolist() == [counts[i] for i, t in enumerate(ODD) if t is not None]


def test_counted_is_postings(spark):
    units = passages(spark).select(F.col("passage_id").alias("chunk_id"), "passage_id", "text")
    for stop in (None, [], ["w1", "the"]):
        want = index.postings(index.lengths(units, stop))
        got = index.counted(units, stop)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_index_of_sentences_is_made_in_one_pass(spark, tmp_path):
    """No spans are written to meet the texts again, and units without terms count."""
    own = passages(spark).where("text <> ''")
    made = Store(own, f"file://{tmp_path}/store")
    stats = made.lexical("sentence").stats.first()
    sizes = [len(r[0]) for r in chunking.chunk_text(chunking.sentence(own), own).select(tx.index_tokens(F.col("text"))).collect()]
    assert (stats["n"], stats["avgdl"]) == (len(sizes), sum(sizes) / len(sizes))
    assert listed(spark, f"{made.path}/{made.key}") == ["df-sentence", "postings-sentence", "stats-sentence"]
    again = Store(own, f"file://{tmp_path}/store")
    again.table = lambda name, make, by=(): make() if name == "stats-sentence" else Store.table(again, name, make, by)
    assert again.lexical("sentence").stats.first() == stats  # counted anew where only the postings are there


def test_several_strategies_take_one_pass(spark):
    own = passages(spark).where("text is not null")
    names = chunking.DEFAULT_STRATEGIES
    made = chunking.several(own, names)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [tuple(r) for name in names for r in chunking.chunker(name)(own).collect()]
    assert made.columns == chunking.whole(own).columns and sorted(map(tuple, made.collect())) == sorted(want)


def test_several_strategies_calibrate_over_all_texts(spark):
    """Texts of even ids have sentences of no common word, the others alike ones, which a sample of every second text would not see."""
    rows = [(i, "One two three. One two four. One two five. Six, two." if i % 2 else f"A{i} b{i}. C{i} d{i} e{i}. F{i} g{i} h{i}. " + f"I{i} j{i} b{i}." * (i % 7)) for i in range(3000)]
    texts = spark.createDataFrame(rows, "passage_id long, text string").repartition(3)
    dist = chunking.adjacent_distances(texts)
    for share in (0.0, 0.1, 0.37, 0.613, 0.75, 0.9, 1.0):
        assert chunking.calibrated_whole(texts, share) == dist.agg(F.expr(f"percentile(dist, {share})")).first()[0]
    assert chunking.calibrated_whole(texts, 0.3) < chunking.calibrated(texts, 0.3)
    assert chunking.calibrated_whole(texts.limit(0)) == 0.5 == chunking.calibrated_whole(texts.selectExpr("passage_id", "'x' as text"))
    alike = texts.withColumn("text", F.when(F.col("passage_id") % 8 == 0, F.col("text")).otherwise("Aa bb cc dd ee. Aa bb cc dd ff. Aa bb cc dd gg."))
    found = lambda made: sorted(map(tuple, made.select("passage_id", "char_start", "char_end").collect()))
    whole = found(chunking.several(alike, ["semantic"]))
    assert whole == found(chunking.semantic(alike, chunking.calibrated_whole(alike))) and whole != found(chunking.semantic(alike))


def test_recursive_counts_are_those_of_the_pieces(spark):
    import re

    token = re.compile(r"[^\W_]+|[^\s\w]|_")
    count = lambda t: sum(1 for _ in token.finditer(t))
    texts = [t for t in ODD if t] + ["ab" * 40 + "_c\x1cd, e; f. " * 9, "x" * 500 + " y" * 300]
    cut = chunking.recursive_runs(7, 3)
    cps, starts = points.points(texts)
    before = points.tokens_before(cps, starts, wide=True)
    owner, s, e = cut(cps, starts, before)
    want = [(i, *x, count(t[slice(*x)])) for i, t in enumerate(texts) for x in chunking.split_spans(t, 7, 3, count)]
    assert list(zip(owner.tolist(), (s - starts[owner]).tolist(), (e - starts[owner]).tolist(), points.n_tokens(cps, before, s, e).tolist())) == want


def test_distances_are_those_of_the_expression(spark):
    texts = ["a b", "", "the cat sat", "the cat ran off", "cat", "été cat", " ".join(f"w{i}" for i in range(1024)), " ".join(f"w{i}" for i in range(1023, 2047))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([""] + texts, texts))], "i int, a string, b string")
    terms = lambda c: F.array_distinct(tx.index_tokens(F.col(c), []))
    want = [r[0] for r in rows.orderBy("i").select(F.round(1 - vectors.term_cosine(terms("a"), terms("b")), 9)).collect()]
    assert chunking.term_distances(texts).tolist() == want and want[-1] == 0.999023438  # 1 - 1/1024, a half at the tenth digit


def test_exploring_writes_no_spans(spark, sf, tmp_path, monkeypatch):
    kept = Store(tables.passages(spark, sf), f"file://{tmp_path}/store")
    monkeypatch.setattr(tables, "store", lambda *_: kept)
    evaluation.explored(spark, sf, ("passage", "sentence")).collect()
    assert not [n for n in listed(spark, f"{kept.path}/{kept.key}") if n.startswith("spans")]


def test_names_meet_sent_terms_where_they_are(spark):
    """No shuffle by gram, which would give one task all names of a frequent one; the pairs are the same."""
    kept = spark.createDataFrame([("alpha beta", 2), ("alphabet", 3), ("gamma", 2), ("betamax", 5)], "name string, doc_freq long")
    terms = spark.createDataFrame([("alphas",), ("beta",), ("gamut",)], "term string")
    plain, sent = (retrieve.name_candidates(terms, kept, 0.3, mark)[0] for mark in (lambda df: df, F.broadcast))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sent.collect()))
    assert sorted(map(tuple, retrieve.holding_names(terms, kept).collect())) == sorted(map(tuple, retrieve.holding_names(terms, kept, F.broadcast).collect()))
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "gram" in line and "strategy=broadcast" in line for line in plan.splitlines())
