"""Layers, evaluation and exploration queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import RETRIEVERS, RetrievalConfig, matrix
from ..functions import text as tx
from ..operators import chunking, layers, metrics, ranking, relations, retrieve
from ..sources import tables
from ..sources.files import written
from ..sources.tables import read
from ..streaming.latency import latency
from . import runs
from .engine import Engine
from .reference import DIST_SQL, FIXED_SQL, ID_LISTS_SQL, QUESTIONS_SQL, SEMANTIC_SQL, STATS_SQL, STOP_SQL, WITH, default_chunks, gold_lists, query, typed_questions, uses
from .retrieval import ENTITY_SQL, MATCH_SQL, MATCHES_SQL, PASSAGES, SENTENCES, WALK_SQL, WITH_QRELS, bm25_sql, cosine_sql, graph_of, hybrid_hits, passage_units, rrf_sql

BM25 = bm25_sql("hits", "passage_units", 10)


def passage_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieve.bm25_indexed(tables.questions(spark, sf_dir), tables.store(spark, sf_dir).lexical("passage"), k)


def sentence_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieve.bm25_indexed(tables.questions(spark, sf_dir), tables.store(spark, sf_dir).lexical("sentence"), k)


def with_text(hits: DataFrame, units: DataFrame) -> DataFrame:
    return units.select("chunk_id", "text").join(tables.small(hits), "chunk_id")


# --- layers


@query("expand_window", uses(*SENTENCES).rstrip() + bm25_sql("hits", "sentence_units", 10) + """, at_ as (select h.*, c.chunk_index from hits h join sentence_chunks c on c.passage_id * 1048576 + c.chunk_index = h.chunk_id),
 wide as (select query_id, chunk_id, a.passage_id, rank, min(c.char_start) as context_start, max(c.char_end) as context_end from at_ a join sentence_chunks c on c.passage_id = a.passage_id and abs(c.chunk_index - a.chunk_index) <= 1 group by 1, 2, 3, 4)
 select query_id, chunk_id, rank, context_start, context_end, substr(text, context_start + 1, context_end - context_start) as context_text from wide join passages using (passage_id)""")
def expand_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = written(sentence_hits(spark, sf_dir), "hits")
    p = retrieve.of_passages(tables.passages(spark, sf_dir), hits)
    return layers.expand_window(hits, chunking.sentence(p), p).select("query_id", "chunk_id", "rank", "context_start", "context_end", "context_text")


@query("expand_parent", uses(*SENTENCES).rstrip() + bm25_sql("hits", "sentence_units", 10) + """, one as (select query_id, passage_id, row_number() over (partition by query_id order by rank)::int as rank from (select *, row_number() over (partition by query_id, passage_id order by rank) as nth from hits) where nth = 1)
 select query_id, passage_id, rank, length(text)::int as context_end, text as context_text from one join passages using (passage_id)""")
def expand_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = written(sentence_hits(spark, sf_dir), "hits")
    return layers.expand_parent(hits, retrieve.of_passages(tables.passages(spark, sf_dir), hits)).select("query_id", "passage_id", "rank", "context_end", "context_text")


@query("rerank", PASSAGES + bm25_sql("hits", "passage_units", 30) + f""", scored as (select h.query_id, h.passage_id, h.rank as before_rank,
   list_distinct(list_filter(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as a, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as b
   from hits h join questions using (query_id) join passages using (passage_id)),
 s as (select query_id, passage_id, before_rank, round(len(list_intersect(a, b)) / sqrt(greatest(len(a) * len(b), 1)::double), 6) as score from scored)
 select *, row_number() over (partition by query_id order by score desc, before_rank)::int as rank from s qualify rank <= 10""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_text(passage_hits(spark, sf_dir, 30), passage_units(tables.passages(spark, sf_dir)))
    return layers.rerank(hits, tables.questions(spark, sf_dir)).select("query_id", "passage_id", "before_rank", "score", "rank")


FIRST = PASSAGES + bm25_sql("hits", "passage_units", 3)
MODEL_SQL = """, shares as (select query_id, chunk_id, score / sum(score) over (partition by query_id) as share from hits),
 theirs as (select query_id, unnest(l) as term, 0.5::double * share / len(l) as weight from shares join hits_l using (chunk_id)),
 own as (select query_id, term, qf * 0.5::double / sum(qf) over (partition by query_id) as weight from hits_q),
 model as (select query_id, term, round(sum(weight), 9) as weight from (select * from theirs union all select * from own) group by all)
"""


@query("relevance_model", FIRST + MODEL_SQL + "select query_id, term, weight, row_number() over (partition by query_id order by weight desc, term)::int as nth from model qualify nth <= 10")
def relevance_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest terms for each question, from its three best passages."""
    units = passage_units(tables.passages(spark, sf_dir))
    return layers.relevance_model(tables.questions(spark, sf_dir), with_text(passage_hits(spark, sf_dir, 3), units))


CLAUSE_SQL = uses("questions").rstrip() + r""", c as (select query_id, query_text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(query_text, '[,;:.?!]( |$)', chr(1) || '\1', 'g'), ' (and|or|but|versus|while|whereas) ', chr(1), 'g'), chr(1)), lambda p: trim(p)),
   lambda p: len(list_filter(regexp_extract_all(lower(p), '[\p{L}\p{N}_]{2,}'), lambda t: t not in (""" + STOP_SQL + """))) >= 2) as parts from questions)
 select query_id, unnest(range(1 + case when len(parts) >= 2 then least(len(parts), 4) else 0 end))::int as nth, unnest(list_concat([query_text], case when len(parts) >= 2 then parts[1:4] else [] end)) as query_text from c"""


@query("question_clauses", CLAUSE_SQL)
def question_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.clauses(tables.questions(spark, sf_dir))


@query("multi_query")
def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, units = tables.questions(spark, sf_dir), passage_units(tables.passages(spark, sf_dir))
    queries = layers.feedback_queries(asked, with_text(passage_hits(spark, sf_dir, 3), units))
    return layers.multi_query(queries, lambda q, k: retrieve.bm25(q, units, k), 10)


@query("listed_queries", r"""with q as (select item_id as query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as query_text from benchmark)
 select query_id, unnest([0, 1, 2]) as nth, unnest([query_text, 'about ' || left(query_text, 20), 'second']) as query_text from q""")
def listed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.questions(spark, sf_dir)
    reply = F.concat(F.lit("Sure: "), F.to_json(F.array(F.concat(F.lit(" "), "query_text"), F.concat(F.lit("about "), F.left("query_text", F.lit(20))), F.lit(" "), F.lit("second"))), F.lit(" done"))
    return layers.listed_queries(asked, asked.select("query_id", reply.alias("reply")), "decompose")


@query("json_list", r"""select item_id as query_id, [item_id::varchar, 'b'] as items from benchmark where item_id % 2 = 0 union all select item_id, []::varchar[] from benchmark where item_id % 2 = 1""")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit('reply ["'), F.col("item_id").cast("string"), F.lit('", " ", "b"] end'))
    text = F.when(F.col("item_id") % 2 == 0, good).otherwise(F.lit("no [list here"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.json_list(text).alias("items"))


ANSWERS_SQL = PASSAGES + BM25 + ", answers as (select query_id, 'Seen in [2][1] and [9], not in [40] or [0]  but [' || (query_id % 12) || '].' as answer from questions)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Seen in [2][1] and [9], not in [40] or [0]  but ["), (F.col("query_id") % 12).cast("string"), F.lit("]."))
    return tables.questions(spark, sf_dir).select("query_id", text.alias("answer"))


@query("cite_extract", ANSWERS_SQL + r" select query_id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{1,2})\]', 1), lambda x: x::int))) as marks from answers")
def cite_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("query_id", tx.cited(F.col("answer")).alias("marks"))


@query("citations", ANSWERS_SQL + r", m as (select query_id, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{1,2})\]', 1), lambda x: x::int))) as n from answers) select m.query_id, n, passage_id, 'https://pubmed.ncbi.nlm.nih.gov/' || passage_id || '/' as url from m join hits h on h.query_id = m.query_id and h.rank = n")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.citations(answers(spark, sf_dir), passage_hits(spark, sf_dir))


@query("cite_check", ANSWERS_SQL + r""", n as (select query_id, count(*) as n_hits from hits group by 1), m as (select query_id, answer, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{1,2})\]', 1), lambda x: x::int))) as marks, coalesce(n_hits, 0) as n_hits from answers left join n using (query_id)),
 v as (select *, list_filter(marks, lambda x: x between 1 and n_hits) as valid, list_filter(marks, lambda x: not (x between 1 and n_hits)) as invalid from m)
 select query_id, valid, invalid, trim(regexp_replace(list_reduce(invalid, lambda a, x: replace(a, '[' || x || ']', ''), answer), '\s{2,}', ' ', 'g')) as cleaned from (select query_id, answer, valid, list_transform(invalid, lambda x: x::varchar) as invalid_text, invalid from v) """.replace("list_reduce(invalid, lambda a, x: replace(a, '[' || x || ']', ''), answer)", "list_reduce(invalid_text, lambda a, x: replace(a, '[' || x || ']', ''), answer)"))
def cite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.checked_answers(answers(spark, sf_dir), passage_hits(spark, sf_dir))


@query("format_context", PASSAGES + BM25 + " select query_id, string_agg('[' || rank || '] (ID ' || passage_id || ') ' || text, chr(10) || chr(10) order by rank) as context from hits join passages using (passage_id) where rank <= 3 group by 1")
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_text(passage_hits(spark, sf_dir, 3), passage_units(tables.passages(spark, sf_dir)))
    return layers.format_context(hits)


@query("answers", PASSAGES + BM25 + r""" select query_id, string_agg(string_split(regexp_replace(text, '([.!?]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))[1] || ' [' || rank || ']', ' ' order by rank) as answer from hits join passages using (passage_id) where rank <= 3 group by 1""")
def answers_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_text(passage_hits(spark, sf_dir, 3), passage_units(tables.passages(spark, sf_dir)))
    return layers.extractive_answers(hits)


@query("hit_compaction", PASSAGES + BM25 + " select query_id, list(passage_id || '@' || rank order by rank) as hits from hits group by 1")
def hit_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = with_text(passage_hits(spark, sf_dir), passage_units(tables.passages(spark, sf_dir)))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id", "text"))).alias("hits"))
    bare = lists.withColumn("hits", F.transform("hits", lambda h: h.dropFields("text")))
    return bare.select("query_id", F.transform("hits", lambda h: F.concat_ws("@", h["passage_id"].cast("string"), h["rank"].cast("string"))).alias("hits"))


@query("is_gold", WITH_QRELS + BM25 + " select h.query_id, h.passage_id, h.rank, r.passage_id is not null as is_gold from hits h left join qrels r using (query_id, passage_id)")
def is_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, p = tables.questions(spark, sf_dir), tables.passages(spark, sf_dir)
    gold = tables.qrels(asked, p).withColumn("is_gold", F.lit(True))
    return passage_hits(spark, sf_dir).join(gold, ["query_id", "passage_id"], "left").select("query_id", "passage_id", "rank", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))


# --- metrics


def metrics_sql(hits: str, name: str, ks: tuple[int, ...] = metrics.KS) -> str:
    """A CTE `name` of question metrics over the hits CTE."""
    cols = []
    for k in ks:
        cols.append(
            f"""case when g > 0 then round(h{k} / g, 6) end as recall_{k}, case when g > 0 then round(h{k} / {k}, 6) end as precision_{k}, case when g > 0 then (h{k} > 0)::int::double end as hit_{k},
   case when g > 0 then round(d{k} / (select sum(1 / log2(i + 1)) from range(1, (least(g, {k}) + 1)::bigint) r(i)), 6) end as ndcg_{k}"""
        )
    sums = ", ".join(f"coalesce(sum((gold and rank <= {k})::int), 0) as h{k}, coalesce(sum(case when gold and rank <= {k} then 1 / log2(rank + 1) end), 0) as d{k}" for k in ks)
    return f""", {name}_f as (select query_id, passage_id, row_number() over (partition by query_id order by rank) as rank from (select *, row_number() over (partition by query_id, passage_id order by rank, chunk_id) as nth from {hits}) where nth = 1),
 {name}_m as (select f.*, r.passage_id is not null as gold from {name}_f f left join qrels r using (query_id, passage_id)),
 {name}_g as (select q.query_id, (select count(*) from qrels r where r.query_id = q.query_id) as g from questions q),
 {name}_a as (select q.query_id, g, count(rank) as n_passages, min(case when gold then rank end)::int as fr, {sums} from {name}_g q left join {name}_m m using (query_id) group by 1, 2),
 {name} as (select query_id, g as n_gold, n_passages, case when g > 0 then coalesce(1 / fr, 0) end as mrr, case when g > 0 then fr end as first_gold_rank, {", ".join(cols)} from {name}_a)
"""


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.qrels(tables.questions(spark, sf_dir), tables.passages(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    asked = tables.questions(spark, sf_dir)
    return metrics.question_metrics(hits, gold_of(spark, sf_dir), asked.select("query_id"))


NAMES = ["mrr", "recall_10", "precision_5", "ndcg_10", "hit_5"]
MEANS = ", ".join(f"round(avg({c}), 6) as {c}" for c in NAMES)


@query("ir_metrics", WITH_QRELS + BM25 + metrics_sql("hits", "m") + "select * from m")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, passage_hits(spark, sf_dir))


@query("running_gain", WITH_QRELS + BM25 + ", g as (select h.query_id, h.rank, case when r.passage_id is not null then 1 / log2(h.rank + 1) else 0.0 end as x from hits h left join qrels r using (query_id, passage_id)) select query_id, rank, round(sum(x) over (partition by query_id order by rank), 6) as dcg from g")
def running_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, p = tables.questions(spark, sf_dir), tables.passages(spark, sf_dir)
    return metrics.running_gain(passage_hits(spark, sf_dir), tables.qrels(asked, p))


BOARD_STRATEGIES = ("passage", "fixed_128_32", "sentence", "semantic")  # those whose chunks SQL can express
BOARD_RETRIEVERS = ("bm25", "dense", "hybrid", "grep", "kg")


def board_sql() -> str:
    """CTEs that end with `board`: mean metrics of every such strategy and retriever, the dense one by term vectors."""
    sql = MATCHES_SQL.replace(uses("passages", "questions").rstrip(), uses("passages", "questions", "qrels", "sent", "spans", "sentence_chunks", "sentence_units", "passage_units").rstrip())
    sql += MATCH_SQL[MATCH_SQL.index(", words as") :]
    sql += ", w as (" + FIXED_SQL.split(", w as (", 1)[1].rstrip()
    sql += DIST_SQL[DIST_SQL.index(", terms as") :].rstrip() + SEMANTIC_SQL.rstrip()
    sql += "".join(f", {n}_units as (select passage_id * 1048576 + chunk_index as chunk_id, c.passage_id, chunk_index, substr(text, char_start + 1, char_end - char_start) as text from {n}_chunks c join passages using (passage_id))" for n in ("fixed", "semantic"))
    sql += WALK_SQL.rstrip() + ", lit50 as (select * from literal qualify row_number() over (partition by query_id order by score desc, passage_id) <= 50), kg40 as (select * from walk qualify row_number() over (partition by query_id order by score desc, passage_id) <= 40)"
    units = {"passage": "passage_units", "fixed_128_32": "fixed_units", "sentence": "sentence_units", "semantic": "semantic_units"}
    rows = []
    for i, (strategy, u) in enumerate(units.items()):
        sql += bm25_sql(f"b{i}", u, 30) + cosine_sql(f"d{i}", f"b{i}", 30) + rrf_sql(f"hybrid{i}", f"d{i}", f"b{i}", 10)
        sql += f""", bm25{i} as (select * from b{i} where rank <= 10), dense{i} as (select * from d{i} where rank <= 10),
 gh{i} as (select query_id, passage_id, score, chunk_id, chunk_index, len(list_filter(terms, lambda t: contains(lower(text), t))) as chunk_hits from lit50 join {u} using (passage_id)),
 go{i} as (select * from gh{i} qualify row_number() over (partition by query_id, passage_id order by chunk_hits desc, chunk_index) = 1),
 grep{i} as (select query_id, chunk_id, passage_id, score, row_number() over (partition by query_id order by score desc, passage_id, chunk_id)::int as rank from go{i} qualify rank <= 10),
 ka{i} as (select query_id, chunk_id, passage_id, chunk_index, score, list_distinct(list_filter(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as a, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as b from kg40 join {u} using (passage_id) join questions using (query_id)),
 ko{i} as (select * from ka{i} qualify row_number() over (partition by query_id, passage_id order by case when len(a) * len(b) = 0 then 0.0 else round(len(list_intersect(a, b)) / sqrt((len(a) * len(b))::double), 6) end desc, chunk_index) = 1),
 kg{i} as (select query_id, chunk_id, passage_id, score, row_number() over (partition by query_id order by score desc, passage_id, chunk_id)::int as rank from ko{i} qualify rank <= 10)
"""
        for r in BOARD_RETRIEVERS:
            sql += metrics_sql(f"{r}{i}", f"m_{r}{i}", (5, 10))
            rows.append(f"select '{strategy}' as strategy, '{r}' as retriever, count(*) as n, {MEANS} from m_{r}{i}")
    return sql + ", board as (" + " union all ".join(rows) + ")\n"


BOARD_SQL = board_sql()


def term_dense(spark: SparkSession, sf_dir: str) -> dict:
    """The dense retriever by term vectors, as a provider of the engine."""
    kept = tables.store(spark, sf_dir)

    def dense(questions: DataFrame, strategy: str, k: int) -> DataFrame:
        return retrieve.term_cosine_indexed(questions, kept.lexical(strategy), k)

    dense.by_terms = True
    return {"dense": dense}


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of every strategy and retriever of the board."""
    engine = Engine(spark, sf_dir, retrievers=term_dense(spark, sf_dir))
    made = engine.evaluate(matrix(BOARD_STRATEGIES, BOARD_RETRIEVERS, top_k=10, candidate_k=30))
    return made.select("strategy", "retriever", "n", *NAMES)


@query("leaderboard", BOARD_SQL + "select * from board order by ndcg_10 desc, strategy, retriever")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).orderBy(F.desc("ndcg_10"), "strategy", "retriever")


@query("pivot_recall", BOARD_SQL + "select strategy, " + ", ".join(f"round(avg(recall_10) filter (retriever = '{r}'), 6) as {r}" for r in BOARD_RETRIEVERS) + " from board group by 1")
def pivot_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pivoted(board(spark, sf_dir), "strategy", "retriever", "recall_10", list(BOARD_RETRIEVERS))


@query("score_scale", "with l as (select event_type, round(avg(value), 6) as ms from events group by 1) select event_type, ms, round(case when hi = lo then 0.5 else (ms - lo) / (hi - lo) end, 6) as scale, round(case when hi = lo then 0.5 else 1 - (ms - lo) / (hi - lo) end, 6) as inverted from l, (select min(ms) as lo, max(ms) as hi from l)")
def score_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies on a scale from 0 to 1, and turned, as less is better."""
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("ms"))
    return metrics.scaled(metrics.scaled(rows, "ms"), "ms", inverted=True, name="inverted")


def rerank_sql() -> str:
    """CTEs base0, second0, base1, second1: hits of two configurations before and after reranking."""
    sql = uses("passages", "questions", "qrels", *SENTENCES, "passage_units").rstrip()
    for i, u in enumerate(("passage_units", "sentence_units")):
        sql += bm25_sql(f"wide{i}", u, 30) + f""", rr{i} as (select h.query_id, h.passage_id, h.chunk_id, h.rank as before_rank, list_distinct(list_filter(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as a,
   list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as b from wide{i} h join questions using (query_id) join {u} c on c.chunk_id = h.chunk_id),
 second{i} as (select query_id, passage_id, chunk_id, row_number() over (partition by query_id order by round(len(list_intersect(a, b)) / sqrt(greatest(len(a) * len(b), 1)::double), 6) desc, before_rank) as rank from rr{i} qualify rank <= 10),
 base{i} as (select * from wide{i} where rank <= 10)"""
    return sql + "".join(metrics_sql(f"{x}{i}", f"m_{x}{i}", (10,)) for i in (0, 1) for x in ("base", "second"))


DELTA_SQL = rerank_sql() + " select strategy, base, other, round(other - base, 6) as gain from (" + " union all ".join(f"select '{s}' as strategy, (select round(avg(mrr), 6) from m_base{i}) as base, (select round(avg(mrr), 6) from m_second{i}) as other" for i, s in enumerate(("passage", "sentence"))) + ")"


@query("rerank_delta", DELTA_SQL)
def rerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reranking gains, by configuration."""
    made = Engine(spark, sf_dir).evaluate(matrix(("passage", "sentence"), ("bm25",), rerank=(False, True), top_k=10, candidate_k=30))
    rows = made.select("strategy", F.when(F.col("rerank"), "rerank").otherwise("base").alias("layer"), "mrr")
    return metrics.delta(rows, "base", "rerank", "mrr", ["strategy"])


TYPE_SQL = """, kind as (select query_id, case when regexp_matches(query_text, '(?i)^(is|are|does|do|can|has|have|was|were|should|could|did|will)\\b') then 'yesno' when regexp_matches(query_text, '(?i)^(list|which|what are|name)\\b') then 'list'
   when len(list_filter(regexp_split_to_array(query_text, '\\s+'), lambda w: w <> '')) > 14 or regexp_matches(lower(query_text), '^(describe|what is the role|what is known|how)') then 'summary' else 'factoid' end as question_type from questions)"""


@query("metrics_by_type", WITH_QRELS + BM25 + metrics_sql("hits", "m") + TYPE_SQL + " select question_type, count(*) as n, round(avg(mrr), 6) as mrr, round(avg(recall_10), 6) as recall_10 from m join kind using (query_id) group by 1")
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tables.questions(spark, sf_dir).select("query_id", tx.question_type(F.col("query_text")).alias("question_type"))
    return metrics.means(scored(spark, sf_dir, passage_hits(spark, sf_dir)).join(kinds, "query_id"), ["question_type"], ["mrr", "recall_10"])


@query("id_context", WITH_QRELS + BM25 + """, got as (select query_id, list_distinct(list(passage_id)) as l from hits group by 1), gl as (select query_id, list_distinct(list(passage_id)) as l from qrels group by 1),
 x as (select q.query_id, coalesce(got.l, []) as a, coalesce(gl.l, []) as b from questions q left join got using (query_id) left join gl using (query_id))
 select query_id, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) as id_precision, case when len(b) > 0 then round(len(list_intersect(a, b)) / len(b), 6) end as id_recall from x""")
def id_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.questions(spark, sf_dir)
    return metrics.id_context(passage_hits(spark, sf_dir), tables.qrels(asked, tables.passages(spark, sf_dir)), asked)


@query("citation_mean", ANSWERS_SQL + r" select round(avg(len(list_distinct(regexp_extract_all(answer, '\[(\d{1,2})\]', 1)))), 6) as n_citations from answers")
def citation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).agg(F.round(F.avg(F.size(tx.cited(F.col("answer")))), 6).alias("n_citations"))


# --- evaluation sets, subsampling


@query("eval_set_stratified", QUESTIONS_SQL.rstrip() + """, c as (select type, count(*) as n_s from typed group by 1), shares as (select type, round_even(150 * n_s / (select count(*) from typed), 0)::int as quota from c)
 select id, type from (select *, row_number() over (partition by type order by md5('42:' || id::varchar), id) as nth from typed) join shares using (type) where nth <= quota""")
def eval_set_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.stratified(typed_questions(spark, sf_dir), "id", "type", 150).select("id", "type")


@query("eval_set_smoke", QUESTIONS_SQL.rstrip() + """, c as (select type, count(*) as n_s from typed group by 1), shares as (select type, round_even(150 * n_s / (select count(*) from typed), 0)::int as quota from c),
 e as (select id, type from (select *, row_number() over (partition by type order by md5('42:' || id::varchar), id) as nth from typed) join shares using (type) where nth <= quota)
 select id, type from (select *, row_number() over (partition by type order by md5('42:' || id::varchar), id) as nth, md5('42:' || id::varchar) as draw from e) order by case when nth = 1 then 0 else 1 end, draw, id limit 5""")
def eval_set_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.smoke_set(eval_set_stratified(spark, sf_dir), "id", "type").select("id", "type")


SUBSAMPLE_SQL = uses("passages", "questions", "qrels").rstrip() + """, safe as (select distinct passage_id as id from qrels where query_id < 10), other as (select distinct passage_id as id from qrels where passage_id not in (select id from safe)),
 half as (select id from other order by md5('42:' || id::varchar), id limit (select greatest(0, (500 - count(*)) // 2) from safe)), chosen as (select id from safe union all select id from half),
 fill as (select passage_id as id from passages where passage_id not in (select id from chosen) order by md5('42:' || passage_id::varchar), passage_id limit (select greatest(0, 500 - count(*)) from chosen)),
 keep as (select case when (select count(*) from passages) <= 500 then null else 1 end as cut, id from (select id from chosen union all select id from fill)), kept_ids as (select id from keep where cut is not null union all select passage_id from passages where (select count(*) from passages) <= 500)
"""


def subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.passages(spark, sf_dir)
    gold = tables.qrels(tables.questions(spark, sf_dir), p)
    return relations.subsample(p.select(F.col("passage_id").alias("id")), gold.where("query_id < 10").select(F.col("passage_id").alias("id")), gold.select(F.col("passage_id").alias("id")), 500)


@query("subsample_keep", SUBSAMPLE_SQL + "select id from kept_ids")
def subsample_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subsampled(spark, sf_dir)


@query("subsample_repair", SUBSAMPLE_SQL.rstrip() + ENTITY_SQL + "select k.name, coalesce(list_sort(list(e.passage_id) filter (i.id is not null)), []) as passage_ids from kept k left join edges e using (name) left join kept_ids i on i.id = e.passage_id group by 1")
def subsample_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _, _ = graph_of(spark, sf_dir)
    lists = edges.groupBy("name").agg(F.collect_list("passage_id").alias("passage_ids"))
    return relations.repaired(lists, "name", "passage_ids", subsampled(spark, sf_dir))


@query("gold_distinct", uses("passages", "questions", "qrels") + "select distinct passage_id as id from qrels")
def gold_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_lists(spark, sf_dir).select(F.explode("ids").alias("id")).distinct()


@query("gold_minus_protected", uses("passages", "questions", "qrels") + "select passage_id as id from qrels except select passage_id from qrels where query_id < 10")
def gold_minus_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold_lists(spark, sf_dir)
    return rows.select(F.explode("ids").alias("id")).subtract(rows.where("query_id < 10").select(F.explode("ids").alias("id")))


# --- run log and exploration


LOG_SQL = "with logs as (select event_id as id, ts as created_at, event_type as source, value as latency_ms, (props::json->>'k')::int as k from events)"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("source"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def filtered_log(log: DataFrame, source: str | None = None, slower_than: float | None = None, most: int = 50) -> DataFrame:
    """The latest rows; a filter that is None does not apply."""
    if source is not None:
        log = log.where(F.col("source") == source)
    if slower_than is not None:
        log = log.where(F.col("latency_ms") > slower_than)
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


@query("log_filter", LOG_SQL + " select id, source, latency_ms, k from logs where latency_ms > 100 order by created_at desc, id desc limit 50")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_log(run_log(spark, sf_dir), slower_than=100).select("id", "source", "latency_ms", "k")


@query("log_summary", LOG_SQL + " select source, count(*) as n, round(avg(latency_ms), 6) as avg_ms, round(quantile_cont(latency_ms, 0.5), 6) as p50, count(*) filter (k is null) as errors from logs group by 1")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.round(F.expr("percentile(latency_ms, 0.5)"), 6).alias("p50"), F.count_if(F.col("k").isNull()).alias("errors"))


@query("stage_totals", "select user_id as run_id, event_type as name, round(sum(value), 6) as ms, greatest(round(sum(value) / sum(sum(value)) over (partition by user_id), 6), 0.01) as share from events group by 1, 2")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("name")).agg(F.sum("value").alias("ms"))
    return layers.timed(stages).withColumn("ms", F.round("ms", 6))


@query("latency_windows", "select time_bucket(interval '1 hour', ts) as start, event_type as source, count(*) as n, round(sum(value), 6) as sum_ms, max(value) as max_ms from events group by 1, 2")
def latency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency(read(spark, sf_dir, "events"))


@query("config_matrix", "select s || '+' || r || case when k then '+rerank' else '' end as label, s as strategy, r as retriever, k as rerank, case when k then 20 else 5 end as depth from (values ('passage'), ('sentence'), ('fixed_128_32')) a(s), (values ('bm25'), ('dense'), ('hybrid'), ('grep'), ('kg')) b(r), (values (false), (true)) c(k)")
def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = matrix(("passage", "sentence", "fixed_128_32"), ("bm25", "dense", "hybrid", "grep", "kg"), rerank=(False, True))
    again = [RetrievalConfig.parse(c.label) for c in configs]
    return spark.createDataFrame([(c.label, c.strategy, c.retriever, c.rerank, c.depth) for c in again], "label string, strategy string, retriever string, rerank boolean, depth int")


@query("built_strategies", STATS_SQL + "select strategy, count(*) as n_chunks from every group by 1 having n_chunks > 0 order by n_chunks")
def built_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.several(tables.passages(spark, sf_dir), ["fixed_128_32", "sentence"]).groupBy("strategy").agg(F.count("*").alias("n_chunks")).where("n_chunks > 0").orderBy("n_chunks")


@query("built_strategies_default")
def built_strategies_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`built_strategies` over all default strategies."""
    return default_chunks(tables.passages(spark, sf_dir)).groupBy("strategy").agg(F.count("*").alias("n_chunks")).orderBy("n_chunks", "strategy")


@query("explore_questions", ID_LISTS_SQL.rstrip() + " select query_id, left(query_text, 300) as preview, len(ids) as n_gold from questions join lists using (query_id) where query_text ilike '%an%' order by query_id limit 50")
def explore_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.questions(spark, sf_dir).where(F.col("query_text").ilike("%an%"))
    rows = asked.join(gold_lists(spark, sf_dir), "query_id").select("query_id", F.left("query_text", F.lit(300)).alias("preview"), F.size("ids").cast("long").alias("n_gold"))
    return rows.orderBy("query_id").limit(50)


@query("explore_question_gold", uses("passages", "questions", "qrels") + "select query_id, passage_id, left(text, 160) as preview from qrels join passages using (passage_id)")
def explore_question_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.passages(spark, sf_dir)
    gold = gold_lists(spark, sf_dir).select("query_id", F.explode("ids").alias("passage_id"))
    return p.join(gold, "passage_id").select("query_id", "passage_id", F.left("text", F.lit(160)).alias("preview"))


EXPLORE_SQL = FIXED_SQL.rstrip() + ",\n" + ",\n".join(f"{n} as ({WITH[n]})" for n in ("sent", "spans", "sentence_chunks")) + ENTITY_SQL.rstrip()
EXPLORE_SQL += """, all_chunks as (select 'fixed_128_32' as strategy, passage_id, chunk_index, char_start, char_end from fixed_chunks union all select 'sentence', passage_id, chunk_index, char_start, char_end from sentence_chunks union all select 'passage', passage_id, 0, 0, length(text) from passages),
 lists as (select passage_id, strategy, list(chunk_index || ':' || char_start || ':' || char_end order by chunk_index) as spans from all_chunks group by 1, 2), names as (select passage_id, list(name order by doc_freq, name) as entities from edges group by 1)
 select passage_id, strategy, spans, coalesce(entities, []) as entities from lists left join names using (passage_id)"""


@query("explore_passage", EXPLORE_SQL)
def explore_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its chunks by strategy and its entities by document frequency. The strategies here are those that
    SQL can express in one statement; `explore_passage_default` has all."""
    return explored(spark, sf_dir, ("passage", "fixed_128_32", "sentence"))


def explored(spark: SparkSession, sf_dir: str, strategies: tuple[str, ...]) -> DataFrame:
    kept = tables.store(spark, sf_dir)
    every = chunking.several(kept.passages, list(strategies))
    lists = every.groupBy("passage_id", "strategy").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "char_start", "char_end"))).alias("all"))
    spans = F.transform("all", lambda x: F.concat_ws(":", x["chunk_index"].cast("string"), x["char_start"].cast("string"), x["char_end"].cast("string")))
    names = kept.edges().groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_freq", "name"))), lambda x: x["name"]).alias("entities"))
    return lists.join(names, "passage_id", "left").select("passage_id", "strategy", spans.alias("spans"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


@query("explore_passage_default")
def explore_passage_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`explore_passage` over all default strategies."""
    return explored(spark, sf_dir, tuple(chunking.DEFAULT_STRATEGIES))


@query("span_segments", uses(*SENTENCES) + ", cuts as (select passage_id, list_sort(list_distinct(list_concat(list(char_start), list(char_end)))) as c from sentence_chunks group by 1) select passage_id, unnest(c[1:len(c) - 1]) as s, unnest(c[2:]) as e from cuts".replace(", cuts", ", cuts", 1))
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces between the cut points of a passage's spans."""
    spans = chunking.sentence(tables.passages(spark, sf_dir))
    cuts = spans.select("passage_id", F.explode(F.array("char_start", "char_end")).alias("s")).distinct()
    return cuts.withColumn("e", F.lead("s").over(Window.partitionBy("passage_id").orderBy("s"))).where("e is not null")


SPAN_ROWS_SQL = STATS_SQL.rstrip() + """, l as (select passage_id, list({'i': chunk_index, 's': char_start, 'e': char_end} order by chunk_index) as l from every where strategy = 'fixed_128_32' group by 1),
 fold as (select passage_id, l, list_reduce(l, lambda a, x: {'ends': case when len(list_filter(a.ends, lambda e: e <= x.s)) = 0 then list_append(a.ends, x.e) else list_transform(a.ends, lambda e, k: case when k = list_position(list_transform(a.ends, lambda z: z <= x.s), true) then x.e else e end) end,
   'at_': list_append(a.at_, case when len(list_filter(a.ends, lambda e: e <= x.s)) = 0 then len(a.ends)::int else (list_position(list_transform(a.ends, lambda z: z <= x.s), true) - 1)::int end)}, {'ends': []::int[], 'at_': []::int[]}).at_ as display from l)
 select passage_id, unnest(list_transform(l, lambda x: x.i)) as chunk_index, unnest(display) as display_row from fold"""


@query("span_rows", SPAN_ROWS_SQL)
def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans dealt to display rows: each goes to the first row that has none in its way."""
    return layers.display_rows(chunking.fixed(tables.passages(spark, sf_dir)))


@query("chunk_total", STATS_SQL + "select count(*) as n_chunks, count(distinct strategy) as n_strategies from every")
def chunk_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks over all strategies."""
    kept = tables.store(spark, sf_dir)
    every = kept.spans("fixed_128_32").unionByName(kept.spans("sentence"))
    return every.agg(F.count("*").alias("n_chunks"), F.count_distinct("strategy").alias("n_strategies"))


@query("answer_judgements", PASSAGES + BM25 + rf""", answers as (select query_id, string_agg(string_split(regexp_replace(text, '([.!?]) ([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))[1] || ' [' || rank || ']', ' ' order by rank) as answer from hits join passages using (passage_id) where rank <= 3 group by 1),
 t as (select query_id, list_distinct(list_filter(regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as a, list_distinct(list_filter(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t not in ({STOP_SQL}))) as b from answers join questions using (query_id))
 select query_id, case when len(a) + len(b) = 0 then 0.0 else round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) end as token_f1, case when len(a) > 0 then round(len(list_intersect(a, b)) / len(a), 6) end as token_support from t""")
def answer_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers judged without a model: token F1 with the question's text and the share of tokens that it supports."""
    answered = layers.extractive_answers(with_text(passage_hits(spark, sf_dir, 3), passage_units(tables.passages(spark, sf_dir))))
    rows = answered.join(tables.questions(spark, sf_dir), "query_id")
    return rows.select("query_id", metrics.token_f1(F.col("answer"), F.col("query_text")).alias("token_f1"), metrics.token_support(F.col("answer"), F.col("query_text")).alias("token_support"))


@query("log_detail", LOG_SQL + " select id, source, latency_ms, k from logs where id % 1000 = 0")
def log_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point gets of run-log rows: those whose id is divisible by 1000."""
    return run_log(spark, sf_dir).where(F.pmod("id", F.lit(1000)) == 0).select("id", "source", "latency_ms", "k")


@query("catalog", "select 'benchmark' as name, count(*) as n_rows from benchmark union all select 'conversations', count(*) from conversations union all select 'documents', count(*) from documents union all select 'embeddings', count(*) from embeddings union all select 'events', count(*) from events union all select 'labels', count(*) from labels union all select 'pages', count(*) from pages")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder's tables with their numbers of rows."""
    names = ("benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages")
    return reduce(DataFrame.unionByName, [read(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in names])


@query("run_results", WITH_QRELS + BM25 + metrics_sql("hits", "m", (10,)) + TYPE_SQL + " select query_id, query_text as question, question_type, mrr, recall_10 from m join kind using (query_id) join questions using (query_id)")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's results with their questions."""
    results = scored(spark, sf_dir, passage_hits(spark, sf_dir)).select("query_id", "mrr", "recall_10")
    return runs.with_questions(results, tables.questions(spark, sf_dir)).select("query_id", "question", "question_type", "mrr", "recall_10")


@query("largest_run", "select user_id as id, n, created_at from (select user_id, count(*) as n, max(ts) as created_at from events group by 1) order by n desc, created_at desc, id limit 1")
def largest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with the most rows of the log."""
    made = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("created_at"))
    return runs.largest(made, "n")


@query("health", "select (select count(*) from documents) as documents, (select count(*) from benchmark) as questions, (select count(*) from embeddings) as vectors")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, name: read(spark, sf_dir, t).agg(F.count("*").alias(name))
    return one("documents", "documents").crossJoin(one("benchmark", "questions")).crossJoin(one("embeddings", "vectors"))  # one row each


@query("ask")
def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question through the whole pipeline: retrieve, rerank, expand, answer, cite, with metrics."""
    return Engine(spark, sf_dir).ask(tables.questions(spark, sf_dir), RetrievalConfig.parse("sentence+bm25+rerank+window", top_k=10, candidate_k=30), gold_of(spark, sf_dir))


COMPARE_SQL = uses(*SENTENCES, "passage_units").rstrip() + bm25_sql("b0", "passage_units", 30) + cosine_sql("d0", "b0", 30) + rrf_sql("h0", "d0", "b0", 10) + bm25_sql("b1", "sentence_units", 10)
COMPARE_SQL += " select 'passage+bm25' as config, * from b0 where rank <= 10 union all select 'passage+dense', * from d0 where rank <= 10 union all select 'passage+hybrid', * from h0 union all select 'sentence+bm25', * from b1"


@query("compare", COMPARE_SQL)
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several configurations side by side."""
    labels = ("passage+bm25", "passage+dense", "passage+hybrid", "sentence+bm25")
    engine = Engine(spark, sf_dir, retrievers=term_dense(spark, sf_dir))
    return engine.compare(tables.questions(spark, sf_dir), [RetrievalConfig.parse(x, top_k=10, candidate_k=30) for x in labels])


@query("eval_matrix")
def eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of every strategy and retriever, with embeddings as vectors: five by five configurations."""
    return Engine(spark, sf_dir).evaluate(matrix(chunking.DEFAULT_STRATEGIES, RETRIEVERS, top_k=10, candidate_k=30))
