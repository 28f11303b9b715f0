"""Source divergence audit: a baseline-correction inverted index over the terms of each language.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Each language keeps the V terms that are in
at least `least_docs` of its documents. A group is one source of a language; with N the sum of its counts of kept terms, a
term of count c there has the weight ``p = 1 + floor(10**9 * (c + 5) / (N + 5 * V))``, and q is the same over the language.
All arithmetic is on integers.

1. *Counts.* One pass over whole texts, in blocks, sums counts and documents by (language, source, term) within a task,
   so only sums are shuffled. The least that fits is held: a task hands over its sums above `HELD` entries.
2. *Index.* Postings (language, term, source, count) of the kept terms.
3. *Baseline.* A pair of sources starts at V times ``f = abs(z - z')``, z the weight of count zero in each group: what the
   pair would have if no term occurred in either.
4. *Corrections.* A term that occurs in one source changes its f from abs(z - z') to abs(p - z'). Terms of one source with
   one count have one p, so these corrections are taken by (source, count). Where both have the term, its posting list
   emits the rest: ``abs(p - p') - abs(p - z') - abs(z - p') + abs(z - z')``, if it is not zero. A list has one entry for
   each source at most, whatever the number of documents, and its pairs are summed before they are shuffled.
5. *Ranks.* Windows over each group's items: all other sources of the language by their sums, and the `top` terms whose
   weight in the group is above that in the language.

Null text, lang and source count as ''. Empty texts have no terms, but their group occurs. Rows repeated with one doc_id
count as documents of their own. Ties of a value are ranked by the item's UTF-8 bytes. A language without kept terms has
pairs of value 0 and no terms. Very long texts are cut into blocks between terms. An empty table gives an empty result.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

HELD = 600_000  # sums that a task holds, of some 200 bytes
ROWS = 1 << 22  # documents that a sum may have
ONE = 1 << 40  # a document
BLOCK = 1 << 20  # bytes of a text that are cut into terms at once
SCALE = 10**9
COUNTS = "lang string, source string, term string, n long, docs long"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def blocks(text: bytes) -> Iterator[bytes]:
    """Pieces of about `BLOCK` bytes that end between terms."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + BLOCK)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi]
        lo = hi


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): counts and documents of each term, and a row of term '' for each group."""
    sums: dict[tuple[str, str], dict[bytes, int]] = {}  # count + documents * 2**40
    held = rows = 0

    def out() -> pa.RecordBatch:
        sizes = [len(terms) for terms in sums.values()]
        both = np.concatenate([np.fromiter(terms.values(), np.int64, len(terms)) for terms in sums.values()])
        names = pa.concat_arrays([pa.array(list(terms), pa.binary()) for terms in sums.values()]).cast(pa.string())
        of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        langs, sources = (pa.array([group[i] for group in sums], pa.string()).take(of) for i in (0, 1))
        return pa.RecordBatch.from_arrays([langs, sources, names, pa.array(both & (ONE - 1)), pa.array(both >> 40)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            group = sums.setdefault((lang, source), {b"": 0})
            before = len(group)
            found: Counter[bytes] = Counter()
            for part in blocks(text.as_py().translate(_LETTERS)):
                found.update(part.split())
            known = group.get
            for term, n in found.items():
                group[term] = known(term, 0) + n + ONE
            held, rows = held + len(group) - before, rows + 1
            if held > HELD or rows > ROWS:
                yield out()
                sums, held, rows = {}, 0, 0
    if sums:
        yield out()


def weight(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * kept)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return F.call_function("div", above, (total + 5 * kept).cast("decimal(20,0)")) + 1


def index(docs: DataFrame, least_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """(postings (lang, term, source, n, n_lang), groups (lang, source, kept, total, lang_total, zero))."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sums = texts.mapInArrow(count_rows, COUNTS)
    counts = stored(sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    postings = stored(counts.where("term <> ''").drop("docs").join(terms, ["lang", "term"]).select("lang", "term", "source", "n", "n_lang"), "term-postings")
    kept = postings.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("lang_total"))
    total = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(kept, "lang", "left").join(total, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"])
    return postings, stored(groups.withColumn("zero", F.when(F.col("kept") > 0, weight(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0)).cast("long")), "term-groups")


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    ours = groups.select("lang", "source", "kept", F.col("zero").alias("z"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("z2"))
    pairs = ours.join(theirs, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("kept") * F.abs(F.col("z") - F.col("z2"))).alias("value"))

    weighted = postings.join(groups.select("lang", "source", "kept", "total", F.col("zero").alias("z")), ["lang", "source"])
    weighted = weighted.select("lang", "term", "source", "z", "n", weight(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    equal = weighted.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.first("z").alias("z"), F.first("p").alias("p"))
    one = equal.join(theirs, "lang").where("source <> item")
    one = one.select("lang", "source", "item", (F.col("terms") * (F.abs(F.col("p") - F.col("z2")) - F.abs(F.col("z") - F.col("z2")))).alias("value")).where("value <> 0")
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    others = weighted.select("lang", "term", F.col("source").alias("item"), F.col("z").alias("z2"), F.col("p").alias("p2"))
    rest = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("z2")) - F.abs(F.col("z") - F.col("p2")) + F.abs(F.col("z") - F.col("z2"))
    both = weighted.join(others, ["lang", "term"]).where("source < item").select("lang", "source", "item", rest.alias("value")).where("value <> 0")
    both = stored(both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "term-corrections")

    def turned(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    parts = base.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the `top`
    terms above the language's weight."""
    postings, groups = index(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (weight(F.col("n"), F.col("total"), F.col("kept")) - weight(F.col("n_lang"), F.col("lang_total"), F.col("kept"))).alias("value")
    )
    ranked = above.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), tokens as (
  select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term, count(*) as n_lang from tokens group by lang, term having count(distinct id) >= 30
), sizes as (
  select lang, count(*) as v, sum(n_lang) as total from kept group by lang
), groups as (
  select distinct lang, source from d
), counts as (
  select lang, source, term, count(*) as n from tokens semi join kept using (lang, term) group by lang, source, term
), totals as (
  select lang, source, sum(n) as total from counts group by lang, source
), weights as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v)::hugeint as p,
         1 + (1000000000::hugeint * (k.n_lang + 5)) // (s.total + 5 * s.v)::hugeint as q
  from groups g join kept k using (lang) join sizes s using (lang) left join totals t using (lang, source) left join counts c using (lang, source, term)
), pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from weights a join weights b using (lang, term) where a.source <> b.source group by all
), rows as (
  select lang, source, 'pair' as part, item, coalesce(value, 0) as value
  from (select a.lang, a.source, b.source as item from groups a join groups b using (lang) where a.source <> b.source) left join pairs using (lang, source, item)
  union all
  select lang, source, 'term', term, p - q from weights where n > 0 and p > q
), ranked as (
  select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from rows
)
select * from ranked where part = 'pair' or rank <= 50
"""
