"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import matrix
from ..functions import text as tx
from ..functions import vectors
from ..operators import chunking, index, layers, metrics, ranking, relations, retrieve, sentences
from ..sources import tables
from ..sources.files import shared_folder
from ..sources.tables import read
from ..sources.versions import Versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Pieces of SQL that queries share, by name; each may use those before it.
WITH = {
    "passages": r"""select * from (select doc_id as passage_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as text, lang, source from documents) where text <> ''""",
    "questions": r"""select item_id as query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as query_text from benchmark""",
    "qrels": "select query_id, passage_id from questions, passages where contains(text, query_text)",
    "sent": r"""select passage_id, i, sentence, len(regexp_extract_all(sentence, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as n_tokens, length(sentence) as n from (
        select passage_id, unnest(range(len(l))) as i, unnest(l) as sentence from (
          select passage_id, string_split(regexp_replace(regexp_replace(text, '([.!?]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), '([.!?]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) as l from passages))""",
    "spans": "select *, (coalesce(sum(n + 1) over (partition by passage_id order by i rows between unbounded preceding and 1 preceding), 0))::int as s from sent",
    "sentence_chunks": """select passage_id, g::int as chunk_index, min(s)::int as char_start, max(s + n)::int as char_end, sum(n_tokens)::int as n_tokens from (
        select *, sum(case when i = 0 or n_tokens >= 6 then 1 else 0 end) over (partition by passage_id order by i) - 1 as g from spans) group by all""",
    "sentence_units": "select passage_id * 1048576 + chunk_index as chunk_id, c.passage_id, chunk_index, substr(text, char_start + 1, char_end - char_start) as text from sentence_chunks c join passages using (passage_id)",
    "passage_units": "select passage_id * 1048576 as chunk_id, passage_id, 0 as chunk_index, text from passages",
}
STOP_SQL = ", ".join(f"'{w}'" for w in tx.INDEX_STOP)
TERM_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(tx.TERM_STOP))


def uses(*names: str) -> str:
    """A WITH clause of the pieces named."""
    return "with " + ",\n".join(f"{n} as ({WITH[n]})" for n in WITH if n in names) + "\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- corpus and tables


@query("corpus_normalise", uses("passages") + r"""select passage_id, text, length(text) as n_chars, len(string_split(text, ' ')) as n_words, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as n_tokens from passages""")
def corpus_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return tables.passages(spark, sf_dir).select("passage_id", "text", F.length(t).alias("n_chars"), tx.n_words(t).alias("n_words"), tx.n_tokens(t).alias("n_tokens"))


@query("corpus_profile", uses("passages") + "select count(*) as n, round(avg(length(text)), 6) as avg_chars, min(length(text)) as min_chars, max(length(text)) as max_chars from passages")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return tables.passages(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


@query("source_counts", "select source, lang, count(*) as n from documents group by all order by n desc, source, lang")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang")


@query("scan_ordered_limit", "select doc_id, lang, source from documents order by doc_id limit 100")
def scan_ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(100)


@query("point_lookup", "select doc_id, lang, left(text, 160) as preview from documents where doc_id in (select doc_id from labels where toxic = 1)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return read(spark, sf_dir, "documents").join(keys, "doc_id", "left_semi").select("doc_id", "lang", F.left("text", F.lit(160)).alias("preview"))


@query("distinct_sources", "select distinct source from documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("source").distinct()


QUESTIONS_SQL = r"""with q as (select item_id as id, text as question from benchmark union all select conv_id * 100 + turn, text from conversations where role = 'user'),
 typed as (select id, question, case when regexp_matches(question, '(?i)^(is|are|does|do|can|has|have|was|were|should|could|did|will)\b') then 'yesno'
   when regexp_matches(question, '(?i)^(list|which|what are|name)\b') then 'list'
   when len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) > 14 or regexp_matches(lower(question), '^(describe|what is the role|what is known|how)') then 'summary' else 'factoid' end as type from q)
"""


def typed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    turns = tables.turns(spark, sf_dir).where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return asked.unionByName(turns).withColumn("type", tx.question_type(F.col("question")))


@query("question_typing", QUESTIONS_SQL + "select id, type from typed")
def question_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_questions(spark, sf_dir).select("id", "type")


@query("question_mix", QUESTIONS_SQL + "select type, count(*) as n, round(avg(length(question)), 6) as avg_chars from typed group by 1")
def question_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_questions(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.length("question")), 6).alias("avg_chars"))


@query("qa_turns", "select conv_id, turn, question, answer from (select conv_id, turn, role, text as question, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant'")
def qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = tables.turns(spark, sf_dir).select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "question", "answer")


@query("qrels", uses("passages", "questions", "qrels") + "select query_id, passage_id from qrels")
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.qrels(tables.questions(spark, sf_dir), tables.passages(spark, sf_dir))


ID_LISTS_SQL = uses("passages", "questions", "qrels").rstrip() + """, lists as (select q.query_id, coalesce(list(passage_id order by passage_id) filter (passage_id is not null), []) as ids from questions q left join qrels using (query_id) group by 1)
"""


def gold_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, ids): gold ids, and for each question one id that no passage has."""
    asked = tables.questions(spark, sf_dir)
    found = tables.qrels(asked, tables.passages(spark, sf_dir)).groupBy("query_id").agg(F.array_sort(F.collect_list("passage_id")).alias("ids"))
    return asked.select("query_id").join(found, "query_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))


@query("id_list_parse", ID_LISTS_SQL + "select query_id, unnest(list_concat(ids, [-1])) as id from lists")
def id_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_text = gold_lists(spark, sf_dir).select("query_id", F.to_json(F.array_append("ids", F.lit(-1).cast("long"))).alias("literal"))
    return as_text.select("query_id", F.explode(F.from_json("literal", "array<bigint>")).alias("id"))


@query("gold_filter", ID_LISTS_SQL + "select query_id, ids as known, 1 as missing from lists")
def gold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = gold_lists(spark, sf_dir).withColumn("ids", F.array_append("ids", F.lit(-1).cast("long"))).withColumn("n", F.size("ids"))
    known = relations.repaired(lists, "query_id", "ids", tables.passages(spark, sf_dir).select(F.col("passage_id").alias("id")))
    return known.select("query_id", F.col("ids").alias("known"), (F.col("n") - F.size("ids")).alias("missing"))


@query("gold_cardinality", ID_LISTS_SQL + "select count(*) filter (len(ids) between 1 and 20) as usable, count(*) filter (len(ids) = 0) as empty, sum(len(ids))::bigint as ids from lists")
def gold_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("ids")
    return gold_lists(spark, sf_dir).agg(F.count_if(n.between(1, 20)).alias("usable"), F.count_if(n == 0).alias("empty"), F.sum(n).alias("ids"))


def kept(spark: SparkSession, rows: DataFrame, key: str) -> Versions:
    """A versioned table of `rows`, which a query changes and reads back as committed."""
    return Versions.create(rows, f"{shared_folder(spark)}/versions/{uuid.uuid4().hex}", key)


@query("upsert", "select doc_id, 1 - toxic as toxic from labels where quality = 0 union all select doc_id, toxic from labels where doc_id not in (select doc_id from labels where quality = 0)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    new = labels.where("quality = 0").select("doc_id", (1 - F.col("toxic")).alias("toxic"))
    return kept(spark, labels.select("doc_id", "toxic"), "doc_id").upsert(new).read()


@query("insert_ignore", "select doc_id, 'labelled' as lang from labels union all select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("lang"))
    return kept(spark, old, "doc_id").insert_ignore(read(spark, sf_dir, "documents").select("doc_id", "lang")).read()


@query("cascade_delete", uses("passages", "sent", "spans", "sentence_chunks") + "select passage_id, chunk_index from sentence_chunks where passage_id not in (select doc_id from labels where quality = 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of low quality go, and their chunks with them: those whose passage the committed version no longer has."""
    passages = tables.passages(spark, sf_dir)
    gone = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("passage_id"))
    left = kept(spark, passages.select("passage_id"), "passage_id").delete(gone)
    chunks = kept(spark, chunking.sentence(passages).select("chunk_id", "passage_id", "chunk_index"), "chunk_id")
    lost = chunks.read().join(left.read(), "passage_id", "left_anti").select("chunk_id")
    return chunks.delete(lost).read().select("passage_id", "chunk_index")


@query("truncate", "select doc_id, quality, toxic from labels where false")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id").truncate().read()


@query("update_from_join", "select doc_id, case when l.doc_id is not null then 'toxic' else d.source end as source from documents d left join (select doc_id from labels where toxic = 1) l using (doc_id)")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("source"))
    return kept(spark, read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").update(changes).read()


@query("integrity_check", "select (select count(*) from labels where doc_id not in (select doc_id from documents)) as labels_without_document, (select count(*) from orders where o_custkey not in (select c_custkey from customer)) as orders_without_customer")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id", "left_anti").agg(F.count("*").alias("labels_without_document"))
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    also = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left_anti").agg(F.count("*").alias("orders_without_customer"))
    return lost.crossJoin(also)  # one row each


@query("text_search", "select doc_id, left(text, 200) as preview from documents where text ilike '%licen%'")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(F.col("text").ilike("%licen%")).select("doc_id", F.left("text", F.lit(200)).alias("preview"))


@query("passage_draw", uses("passages") + r"""select passage_id, n_tokens from (select passage_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as n_tokens from passages) where n_tokens between 150 and 400 order by md5('42:' || passage_id::varchar), passage_id limit 10""")
def passage_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.passages(spark, sf_dir).select("passage_id", tx.n_tokens(F.col("text")).alias("n_tokens")).where("n_tokens between 150 and 400")
    return rows.orderBy(relations.drawn(F.col("passage_id")), "passage_id").limit(10)


@query("array_explode_adjacent", uses("passages") + "select word, count(*) as n from (select unnest(list_distinct(string_split(lower(text), ' '))) as word from passages) group by 1 having n >= 20")
def array_explode_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tables.passages(spark, sf_dir).select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")


# --- sentences and chunks


@query("sentence_spans", uses("passages", "sent", "spans") + "select passage_id, i::int as i, s, (s + n)::int as e, n_tokens::int as n_tokens from spans")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_rows(tables.passages(spark, sf_dir)).select("passage_id", "i", "s", "e", "n_tokens")


LEARNED_SQL = r"""lw as (select lower(regexp_extract(w, '^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}.]*$', 1)) as w from (select unnest(string_split(text, ' ')) as w from passages)),
 lc as (select case when w like '%.' then left(w, length(w) - 1) else w end as word, count(*) filter (w like '%.') as with_stop, count(*) filter (w not like '%.') as without from lw group by 1 having regexp_matches(word, '\p{L}')),
 lt as (select sum(with_stop) as stops, sum(with_stop) + sum(without) as n_words, sum(with_stop) / (sum(with_stop) + sum(without)) as p from lc),
 ln_ as (select *, length(word) - length(replace(word, '.', '')) as inn, length(replace(word, '.', '')) as size from lc, lt where with_stop > 0),
 learned as (select word, with_stop, without, round(2 * ((with_stop * ln(0.99) + without * ln(0.01)) - (with_stop * ln(p) + case when p < 1 then without * ln(1 - p) else 0 end)) * exp(-size) * (inn + 1) * pow(size, -without::double), 6) as score from ln_)
"""


@query("abbreviations", uses("passages").rstrip() + ", " + LEARNED_SQL + "select word, with_stop, without, score from learned where score >= 0.3")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose stop belongs to them, by the corpus's own statistics."""
    return sentences.scores(sentences.counts(tables.passages(spark, sf_dir))).where(F.col("score") >= sentences.LEAST)


@query("sentence_spans_learned", uses("passages", "sent", "spans").rstrip() + ", " + LEARNED_SQL + r""",
 tail as (select passage_id, i, s, s + n as e, lower(regexp_extract(string_split(sentence, ' ')[-1], '^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}.]*$', 1)) as w from spans),
 marked as (select *, w like '%.' and left(w, length(w) - 1) in (select word from learned where score >= 0.3) as abbreviated from tail),
 opened as (select *, sum(case when coalesce(before, false) then 0 else 1 end) over (partition by passage_id order by s) - 1 as g from (select *, lag(abbreviated) over (partition by passage_id order by s) as before from marked))
 select passage_id, g::int as i, min(s)::int as s, max(e)::int as e from opened group by passage_id, g""")
def sentence_spans_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that do not break behind the corpus's own abbreviations."""
    passages = tables.passages(spark, sf_dir)
    return sentences.sentence_rows(passages, sentences.abbreviations(passages))


@query("offsets_sanitise", """with d as (select doc_id, length(text)::int as n from documents), st as (select doc_id, n, list_filter([3, n // 2, n + 5], lambda x: x >= 0 and x < n) as l from d),
 f as (select doc_id, n, case when len(l) = 0 then [0] when l[1] <> 0 then list_concat([0], l) else l end as l from st),
 z as (select doc_id, unnest(l)::int as s, unnest(list_concat(l[2:], [n]))::int as e from f) select doc_id, s, e from z where e > s""")
def offsets_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    starts = F.array(F.lit(3), F.floor(n / 2).cast("int"), n + 5)
    spans = read(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sanitise_offsets(starts, n)).alias("x"))
    return spans.select("doc_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("trim_spans", """with d as (select doc_id, text, unnest(range(0, length(text), 200)) as a from documents), p as (select doc_id, a, substr(text, a + 1, 200) as b from d)
 select doc_id, (a + case when ltrim(b) = '' then length(b) else length(b) - length(ltrim(b)) end)::int as s, (a + length(case when ltrim(b) = '' then b else rtrim(b) end))::int as e from p""")
def trim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 code points over each whole text, trimmed."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,200}"), F.lit(0))).alias("i", "body"))
    s, e = tx.trim_span(F.col("body"), F.lit(0), F.length("body"))
    return rows.select("doc_id", (F.col("i") * 200 + s).cast("int").alias("s"), (F.col("i") * 200 + e).cast("int").alias("e"))


@query("chunk_passage", uses("passages") + r"""select passage_id * 1048576 as chunk_id, 'passage' as strategy, passage_id, 0 as chunk_index, 0 as char_start, length(text)::int as char_end, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))::int as n_tokens from passages""")
def chunk_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whole(tables.passages(spark, sf_dir))


FIXED_SQL = uses("passages").rstrip() + r""", w as (select passage_id, string_split(text, ' ') as l from passages), k as (select *, len(l) as n from w),
 c as (select passage_id, l, n, unnest(range(case when n <= 128 then 1 else 1 + ceil((n - 128) / 96.0)::int end)) as i from k),
 b as (select passage_id, i, case when i = 0 then 0 else length(array_to_string(l[1:96 * i], ' ')) + 1 end as s, array_to_string(l[96 * i + 1:least(96 * i + 128, n)], ' ') as body from c),
 fixed_chunks as (select passage_id, i::int as chunk_index, s::int as char_start, (s + length(body))::int as char_end, len(regexp_extract_all(body, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))::int as n_tokens from b)
"""


@query("chunk_fixed", FIXED_SQL + "select passage_id * 1048576 + chunk_index as chunk_id, 'fixed_128_32' as strategy, * from fixed_chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(tables.passages(spark, sf_dir))


@query("chunk_sentence", uses("passages", "sent", "spans", "sentence_chunks") + "select passage_id * 1048576 + chunk_index as chunk_id, 'sentence' as strategy, * from sentence_chunks")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence(tables.passages(spark, sf_dir))


DIST_SQL = uses("passages", "sent", "spans").rstrip() + r""", terms as (select *, list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]{2,}')) as t from spans),
 pairs as (select *, lag(t) over (partition by passage_id order by i) as p from terms),
 dists as (select passage_id, i, s, n, n_tokens, case when p is null then null else round(1 - case when len(p) * len(t) = 0 then 0.0 else len(list_intersect(p, t)) / sqrt((len(p) * len(t))::double) end, 9) end as dist from pairs)
"""


@query("adjacent_distances", DIST_SQL + "select passage_id, i::int as i, dist from dists")
def adjacent_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.adjacent_distances(tables.passages(spark, sf_dir)).select("passage_id", "i", "dist")


THRESHOLD_SQL = """, ranked_ids as (select passage_id, row_number() over (order by passage_id) - 1 as r, greatest(1, count(*) over () // 1500) as step from passages),
 cal as (select coalesce(quantile_cont(dist, 0.75), 0.5) as threshold from dists where passage_id in (select passage_id from ranked_ids where r % step = 0 and r < step * 1500))
"""


@query("calibrate_p75", DIST_SQL + THRESHOLD_SQL + "select threshold from cal")
def calibrate_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(float(chunking.calibrated(tables.passages(spark, sf_dir))),)], "threshold double")


SEMANTIC_SQL = THRESHOLD_SQL.rstrip() + """, sem_g as (select passage_id, list({'i': i, 's': s, 'e': s + n, 't': n_tokens, 'd': coalesce(dist, 0.0)} order by i) as l from dists group by 1),
 sem_f as (select passage_id, l, list_reduce(l, lambda a, x: {'f': list_append(a.f, a.g + case when x.i > 0 and ((x.d > (select threshold from cal) and a.k >= 6) or a.k + x.t > 256) then 1 else 0 end),
   'g': a.g + case when x.i > 0 and ((x.d > (select threshold from cal) and a.k >= 6) or a.k + x.t > 256) then 1 else 0 end,
   'k': case when x.i = 0 or ((x.d > (select threshold from cal) and a.k >= 6) or a.k + x.t > 256) then x.t else a.k + x.t end}, {'f': []::int[], 'g': 0::int, 'k': 0::bigint}).f as fl from sem_g),
 sem_u as (select passage_id, unnest(l) as x, unnest(fl) as g from sem_f), semantic_chunks as (select passage_id, g::int as chunk_index, min(x.s)::int as char_start, max(x.e)::int as char_end, sum(x.t)::int as n_tokens from sem_u group by all)
""".replace("(select threshold from cal)", "x.th").replace("'d': coalesce(dist, 0.0)}", "'d': coalesce(dist, 0.0), 'th': (select threshold from cal)}")


@query("chunk_semantic", DIST_SQL.rstrip() + SEMANTIC_SQL + " select passage_id * 1048576 + chunk_index as chunk_id, 'semantic' as strategy, * from semantic_chunks")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the calibrated threshold."""
    return chunking.semantic(tables.passages(spark, sf_dir))


PIECE_SQL = r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"
OFFSETS_SQL = uses("passages").rstrip() + rf""", pc as (select passage_id, text, list_transform(regexp_extract_all(text, '{PIECE_SQL}'), lambda x: length(x)) as l from passages),
 offs as (select passage_id, text, list_concat(list_transform(range(len(l)), lambda i: coalesce(list_sum(l[1:i]), 0)::int), [length(text)::int]) as o, len(l) as n from pc)
"""
TOKEN_WINDOWS_SQL = OFFSETS_SQL.rstrip() + r""", tw as (select passage_id, text, o, n, unnest(range(case when n <= 128 then 1 else 1 + ceil((n - 128) / 96.0)::int end)) as i from offs),
 raw_spans as (select passage_id, text, i, case when n <= 128 then 0 else o[96 * i + 1] end as s, case when n <= 128 then length(text) else o[least(96 * i + 128, n) + 1] end as e from tw),
 snapped as (select passage_id, text, i, s - length(regexp_extract(left(text, s), '[^ ]*$')) as s, e + length(regexp_extract(substr(text, e + 1), '^[^ ]*')) as e from raw_spans),
 token_chunks as (select passage_id, (row_number() over (partition by passage_id order by i) - 1)::int as chunk_index, char_start::int as char_start, char_end::int as char_end, len(regexp_extract_all(substr(text, char_start + 1, char_end - char_start), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))::int as n_tokens
   from (select passage_id, text, i, s + length(b) - length(ltrim(b)) as char_start, e - (length(b) - length(rtrim(b))) as char_end from (select *, substr(text, s + 1, e - s) as b from snapped) where trim(b) <> ''))
""".replace("\\\\", "\\")


@query("token_offsets", OFFSETS_SQL + "select passage_id, o as offsets from offs")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.passages(spark, sf_dir).select("passage_id", chunking.token_offsets(F.col("text")).alias("offsets"))


@query("chunk_tokens", TOKEN_WINDOWS_SQL + "select passage_id * 1048576 + chunk_index as chunk_id, 'tokens_128_32' as strategy, * from token_chunks")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows widened to whole words."""
    return chunking.tokens(tables.passages(spark, sf_dir))


@query("finalise_spans", r"""with d as (select doc_id as passage_id, coalesce(text, '') as text, unnest(range(0, length(coalesce(text, '')), 90)) as a from documents), p as (select passage_id, a, text, substr(text, a + 1, 90) as b from d),
 t as (select passage_id, a, a + length(b) - length(ltrim(b, ' ')) as s, a + length(rtrim(b, ' ')) as e from p where trim(b, ' ') <> '')
 select passage_id, (row_number() over (partition by passage_id order by a) - 1)::int as chunk_index, s::int as char_start, e::int as char_end from t""")
def finalise_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw windows of 90 code points over each whole text: trimmed, without empty ones, numbered anew."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.coalesce("text", F.lit("")).alias("text"))
    raw = rows.select("passage_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,90}"), F.lit(0))).alias("chunk_index", "body")).withColumn("s", 90 * F.col("chunk_index"))
    return chunking.finalised(raw).drop("body")


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive(tables.passages(spark, sf_dir))


STATS_SQL = FIXED_SQL.rstrip() + ",\n" + ",\n".join(f"{n} as ({WITH[n]})" for n in ("sent", "spans", "sentence_chunks")) + """, every as (select 'fixed_128_32' as strategy, * from fixed_chunks union all select 'sentence', * from sentence_chunks)
"""


@query("chunk_stats", STATS_SQL + "select strategy, count(*) as n_chunks, round(avg(n_tokens), 6) as avg_tokens, round(count(*) / count(distinct passage_id), 6) as per_passage from every group by 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunking.several(tables.passages(spark, sf_dir), ["fixed_128_32", "sentence"]))


def default_chunks(passages: DataFrame) -> DataFrame:
    return chunking.several(passages, chunking.DEFAULT_STRATEGIES)


@query("chunk_stats_default")
def chunk_stats_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chunk_stats` over all default strategies."""
    return chunking.chunk_stats(default_chunks(tables.passages(spark, sf_dir)))


@query("chunk_counts", STATS_SQL + "select p.passage_id, count(e.passage_id) as n_chunks from passages p left join (select * from every where strategy = 'sentence') e using (passage_id) group by 1")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.passages(spark, sf_dir)
    n = chunking.sentence(p).groupBy("passage_id").agg(F.count("*").alias("n_chunks"))
    return p.select("passage_id").join(n, "passage_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


@query("chunk_text", uses("passages", "sent", "spans", "sentence_chunks", "sentence_units") + "select chunk_id, text from sentence_units")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.passages(spark, sf_dir)
    return chunking.chunk_text(chunking.sentence(p), p).select("chunk_id", "text")


@query("chunk_preview")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy that needs no calibration, over the questions as texts."""
    texts = tables.questions(spark, sf_dir).select(F.col("query_id").alias("passage_id"), F.col("query_text").alias("text"))
    made = chunking.whole(texts)
    for name in ("fixed_128_32", "recursive_128_32", "sentence"):
        made = made.unionByName(chunking.chunker(name)(texts))
    return chunking.chunk_text(made, texts)


@query("chunk_embed")
def chunk_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.passages(spark, sf_dir)
    return chunking.embed_chunks(chunking.chunk_text(chunking.sentence(p), p)).select("chunk_id", "passage_id", "embedding")
