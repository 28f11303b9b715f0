"""The English stemmer against the published sample of the algorithm's description, and an index built with it."""

from conftest import rows_of
from pyspark.sql import functions as F

from quillon.functions import stem
from quillon.operators import index, retrieve

#: The sample vocabulary of the algorithm's description, words and stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave
knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew
knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()

RULES = {
    "caresses": "caress", "ties": "tie", "cries": "cri", "tied": "tie", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "luxuriated": "luxuri", "hopping": "hop",
    "hoping": "hope", "bed": "bed", "cry": "cri", "by": "by", "say": "say", "sky": "sky", "skies": "sky", "news": "news", "dying": "die", "inning": "inning", "innings": "inning", "proceeding": "proceed",
    "generate": "generat", "generally": "general", "communism": "communism", "arsenic": "arsenic", "relational": "relat", "conditional": "condit", "rationalize": "ration", "hopefulness": "hope",
    "analogies": "analog", "apology": "apolog", "easily": "easili", "quickly": "quick", "formative": "format", "adoption": "adopt", "controlling": "control", "rate": "rate", "youth": "youth", "boyish": "boyish",
    "sayyid": "sayyid", "dog's": "dog", "'tis": "tis", "ü": "ü", "größen": "größen", "42nd": "42nd", "": "",
}


def test_published_sample_and_rules(spark):
    want = dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True)) | RULES
    rows = spark.createDataFrame([(w,) for w in [*want, *want, None]], "other string")
    got = {r["term"]: r["stem"] for r in stem.stems(rows, "other").collect()}
    assert got == want


def test_no_terms_and_no_python(spark):
    none = stem.stems(spark.createDataFrame([], "term string"))
    assert none.collect() == [] and none.columns == ["term", "stem"]
    assert "Python" not in none._jdf.queryExecution().executedPlan().toString()


def test_long_term(spark):
    long = "x" * 100_000 + "ations"
    assert stem.stems(spark.createDataFrame([(long,)], "term string")).first()["stem"] == long[:-1]  # R1 begins in "ation"


def test_index_by_stem(spark):
    units = spark.createDataFrame([(1, 1, "Nodes relate; a node relates relations"), (2, 2, "relating the related"), (3, 3, ""), (4, 4, None)], "chunk_id long, passage_id long, text string")
    tokens = index.lengths(units)
    postings = index.postings(tokens).withColumn("bucket", index.bucket(F.col("term")))
    found = index.stemmed(index.Lexical(postings, postings.groupBy("term").agg(F.count("*").alias("df")), tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))))
    rows = {(r["term"], r["chunk_id"]): (r["tf"], r["dl"], r["n_terms"]) for r in found.postings.collect()}
    assert rows == {("node", 1): (2, 5, 2), ("relat", 1): (3, 5, 2), ("relat", 2): (2, 2, 1)}
    assert {r["term"]: r["df"] for r in found.df.collect()} == {"node": 1, "relat": 2}
    asked = spark.createDataFrame([(7, "Which relation?"), (8, "noded"), (9, None)], "query_id long, query_text string")
    hits = retrieve.bm25_stemmed(asked, found)
    assert sorted((r["query_id"], r["chunk_id"]) for r in hits.collect()) == [(7, 1), (7, 2), (8, 1)]


def test_index_by_stem_is_made_from_texts(spark, tmp_path, monkeypatch):
    """No postings by term are written and none are shuffled; the rows are those of `index.stemmed`."""
    from quillon.sources.files import listed
    from quillon.sources.store import Store

    texts = ["The connected connection connects. Running ran runs", "nothing", "the of", "Connection of été 9s, skies; sky skis", *("generalization generally w%d" % i for i in range(30))]
    p = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string").repartition(3)
    kept = Store(p, f"file://{tmp_path}/a")
    made = kept.stemmed("passage")
    assert made.postings.select("tf").count() and not any(n.startswith("postings") for n in listed(spark, f"{kept.path}/{kept.key}"))
    want = index.stemmed(Store(p, f"file://{tmp_path}/b").lexical("passage"))
    names = ["term", "chunk_id", "passage_id", "dl", "n_terms", "tf", "bucket"]
    assert rows_of(made.postings.select(names)) == rows_of(want.postings.select(names)) and rows_of(made.df) == rows_of(want.df) and rows_of(made.stats) == rows_of(want.stats)
    counts = rows_of(want.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    assert rows_of(kept.stem_counts("passage")) == counts
    monkeypatch.setattr(index, "stem_map", lambda units: None)
    other = Store(p, f"file://{tmp_path}/c")
    assert rows_of(other.stemmed("passage").postings.select(names)) == rows_of(want.postings.select(names)) and rows_of(other.stem_counts("passage")) == counts
