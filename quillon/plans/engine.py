"""The pipeline over a frame of questions: transform, retrieve, rerank, expand, answer, cite; and its evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import RetrievalConfig
from ..functions import vectors
from ..operators import chunking, layers, metrics, ranking, retrieve, scan
from ..settings import Settings, settings as settings_of_process
from ..sources import tables
from ..sources.files import written

COMMON = ["query_id", "chunk_id", "passage_id", "score", "rank"]
METRICS = ["mrr", *(f"{m}_{k}" for m in ("recall", "precision", "hit", "ndcg") for k in metrics.KS)]


class Engine:
    """Retrieval over the documents of a folder, by stored chunks, postings, vectors and edges, which are built once for a
    state of the corpus (`sources.store`).

    Providers: `embed` (text -> vector, named `embedding` where its vectors are stored), `score` (question, text -> number)
    for reranking, `likeness` (question, text -> cosine) for the chunk that stands for a passage in graph retrieval, `judge`
    (answer, gold text -> number), `retrievers` (name -> function of questions, strategy and k that gives hits). `settings` has
    the numbers of the retrievers and what `ask` does by default; those of the process, if none are given.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        embed=None,
        embedding: str | None = None,
        score: Callable[[Column, Column], Column] = layers.lexical_score,
        likeness: Callable[[Column, Column], Column] = retrieve.term_likeness,
        judge: Callable[[Column, Column], Column] = metrics.token_f1,
        retrievers: dict[str, Callable[[DataFrame, str, int], DataFrame]] | None = None,
        settings: Settings | None = None,
    ) -> None:
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings or settings_of_process()
        if embed is not None and not embedding:
            raise ValueError("name the embedding, so that its vectors are not taken for another model's")
        if embed is None and embedding is not None:
            raise ValueError("a named embedding needs its model")
        dim = self.settings.embedding_dim
        self.embed, self.embedding = embed or vectors.hashing_embedder(dim), embedding or f"hashed_{dim}"
        self.score, self.likeness, self.judge = score, likeness, judge
        self.retrievers = retrievers or {}
        self.passages = tables.passages(spark, sf_dir)
        self.store = tables.store(spark, sf_dir)
        self.stages: list[tuple[str, float]] = []

    def units(self, strategy: str) -> DataFrame:
        """(chunk_id, passage_id, chunk_index, char_start, char_end, text)."""
        return self.store.units(strategy)

    def _chunks_of(self, strategy: str) -> Callable[[DataFrame], DataFrame]:
        """The chunks of some passages, with their text, cut from those passages alone."""
        if strategy == "passage":
            return lambda p: p.select(chunking.chunk_id(F.col("passage_id"), F.lit(0)).alias("chunk_id"), "passage_id", F.lit(0).alias("chunk_index"), "text")
        cut = self.store.cut(strategy)
        return (lambda p: chunking.cut_units(p, cut)) if cut else (lambda p: chunking.chunk_text(self.store.spans(strategy), p))

    def text_of(self, questions: DataFrame, hits: DataFrame, strategy: str) -> DataFrame:
        """(chunk_id, text) of the chunks among written `hits` of `questions`: only their passages are fetched and cut."""
        sent = retrieve.sender(questions)
        found = self.passages.join(sent(hits.select("passage_id").distinct()), "passage_id", "left_semi")
        if strategy == "passage":
            return self._chunks_of(strategy)(found).select("chunk_id", "text")
        spans = self.store.spans(strategy).join(sent(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
        return chunking.chunk_text(spans, found).select("chunk_id", "text")

    def _dense(self, questions: DataFrame, strategy: str, k: int) -> DataFrame:
        asked = questions.select("query_id", self.embed(F.col("query_text")).alias("query_vec"))
        kept = self.store.vectors(strategy, self.embedding, self.embed)
        ours, theirs = (row[0] if (row := df.select(F.size(c)).first()) else None for df, c in ((asked, "query_vec"), (kept, "embedding")))
        if None not in (ours, theirs) and ours != theirs:
            raise ValueError(f"{self.embedding}: stored vectors have {theirs} dimensions, the model gives {ours}")
        return retrieve.dense(asked, kept, k)

    def _best_literal(self, questions: DataFrame) -> DataFrame:
        return retrieve.literal_passages(questions, self.passages, self.settings.grep_candidates)

    def _best_graph(self, questions: DataFrame) -> DataFrame:
        own = self.settings
        scored = retrieve.graph_scores(questions, self.store.edges(), self.store.entities(), self.store.n, own.graph_candidates, own.graph_neighbours, own.graph_damping)
        return ranking.ranked(scored, ["query_id"], [F.desc("score"), F.asc("passage_id")], own.graph_candidates, "nth")

    def _lexical(self, questions: DataFrame, strategy: str, k: int) -> DataFrame:
        return retrieve.bm25_indexed(questions, self.store.lexical(strategy), k, self.settings.bm25_k1, self.settings.bm25_b)

    def _list(self, name: str, questions: DataFrame, strategy: str, k: int, best: dict) -> DataFrame:
        """The k best by `bm25` or `dense`, of a longer list if there is one."""
        if (strategy, name) in best:
            return best[strategy, name].where(F.col("rank") <= k)
        if name in self.retrievers:
            return self.retrievers[name](questions, strategy, k)
        return self._lexical(questions, strategy, k) if name == "bm25" else self._dense(questions, strategy, k)

    def _base(self, questions: DataFrame, config: RetrievalConfig, k: int, best: dict | None = None) -> DataFrame:
        """Hits of a retriever. `best`: what is known for these questions already (`all_hits`): passages that grep and kg have found, for any
        strategy, with their `texts`, and lists by (strategy, bm25 or dense)."""
        name, strategy, best = config.retriever, config.strategy, best or {}
        if name in ("bm25", "dense"):
            return self._list(name, questions, strategy, k, best)
        if name in self.retrievers:
            return self.retrievers[name](questions, strategy, k)
        if name == "hybrid":
            return ranking.rrf({x: self._list(x, questions, strategy, 3 * k, best) for x in ("dense", "bm25")}, k, constant=self.settings.rrf_constant)
        texts = best.get("texts", self.passages)
        if name == "grep":
            found = best["grep"] if "grep" in best else self._best_literal(questions)
            return retrieve.literal(questions, texts, self._chunks_of(strategy), k, best=found)
        found = best["kg"] if "kg" in best else self._best_graph(questions)
        return retrieve.graph(questions, None, None, self.store.n, texts, self._chunks_of(strategy), k, likeness=self.likeness, best=found)

    def queries(self, questions: DataFrame, config: RetrievalConfig) -> DataFrame:
        """(query_id, nth, query_text) of a transform: hyde asks with a relevance model of the first hits, multi_query with the first
        sentence of each, decompose with the question's clauses."""
        if config.transform == "decompose":
            return layers.clauses(questions)
        first = written(self._base(questions, config, 3), "first-hits")
        text = self.text_of(questions, first, config.strategy).join(retrieve.sender(questions)(first), "chunk_id")
        return layers.hypothetical(questions, text) if config.transform == "hyde" else layers.feedback_queries(questions, text)

    def retrieve(self, questions: DataFrame, config: RetrievalConfig, best: dict | None = None) -> DataFrame:
        """Hits after the transform, retrieval and reranking."""
        if config.transform == "none":
            hits = self._base(questions, config, config.depth, best).select(COMMON)
        else:
            hits = layers.multi_query(self.queries(questions, config), lambda q, k: self._base(q, config, k), config.depth).select(COMMON)
        if config.rerank:
            hits = written(hits, "candidates")
            text = self.text_of(questions, hits, config.strategy).join(retrieve.sender(questions)(hits), "chunk_id")
            hits = layers.rerank(text, questions, config.top_k, self.score).select(COMMON)
        return hits

    def with_context(self, hits: DataFrame, config: RetrievalConfig) -> DataFrame:
        """Hits with `text`, the context that the answer sees."""
        if config.expansion == "window":
            spans = self.units("passage").drop("text") if config.strategy == "passage" else self.store.spans(config.strategy)  # no text is cut for them
            return layers.expand_window(hits, spans, self.passages).withColumnRenamed("context_text", "text")
        if config.expansion == "parent":
            return layers.expand_parent(hits, self.passages).withColumnRenamed("context_text", "text")
        return self.units(config.strategy).select("chunk_id", "text").join(hits, "chunk_id")

    def default_config(self) -> RetrievalConfig:
        own = self.settings
        return RetrievalConfig(own.strategy, own.retriever, top_k=own.top_k, candidate_k=own.candidate_k)

    def ask(self, questions: DataFrame, config: RetrievalConfig | None = None, gold: DataFrame | None = None) -> DataFrame:
        """(query_id, answer, passages, valid, invalid): an extractive answer to each question with checked citations. With
        `gold` (query_id, passage_id) also is_gold of each passage, mrr and recall_10."""
        config = config or self.default_config()
        hits = written(self.retrieve(questions, config), "hits")  # four plans read them
        context = self.with_context(hits, config)
        checked = layers.checked_answers(layers.extractive_answers(context), hits)
        lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda h: h["passage_id"]).alias("passages"))
        rows = questions.select("query_id").join(lists, "query_id", "left").join(checked, "query_id", "left").select("query_id", F.col("cleaned").alias("answer"), "passages", "valid", "invalid")
        if gold is None:
            return rows
        right = gold.groupBy("query_id").agg(F.collect_set("passage_id").alias("right"))
        none = F.array().cast("array<long>")
        rows = rows.join(right, "query_id", "left").withColumn("is_gold", F.transform("passages", lambda p: F.array_contains(F.coalesce("right", none), p))).drop("right")
        return rows.join(metrics.question_metrics(hits, gold, questions.select("query_id")).select("query_id", "mrr", "recall_10"), "query_id")

    def judged(self, answers: DataFrame, gold_texts: DataFrame) -> DataFrame:
        """(query_id, judgement) of answers (query_id, answer) against texts (query_id, text); NaN counts as none."""
        made = answers.join(gold_texts, "query_id").select("query_id", self.judge(F.col("answer"), F.col("text")).alias("judgement"))
        return made.withColumn("judgement", F.when(~F.isnan("judgement"), F.col("judgement")))

    def compare(self, questions: DataFrame, configs: list[RetrievalConfig]) -> DataFrame:
        """Hits with `config`, for up to six configurations."""
        if not 1 <= len(configs) <= 6:
            raise ValueError("one to six configurations")
        return reduce(DataFrame.unionByName, [self.retrieve(questions, c).withColumn("config", F.lit(c.label)) for c in configs])

    def timed(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """`make()`, written and read again; its seconds are noted under `name` in `stages`."""
        from ..sources.files import shared_folder

        began = time.perf_counter()
        at = f"{shared_folder(self.spark)}/stages/{self.spark.sparkContext.applicationId}-{time.time_ns()}"
        make().write.parquet(at)
        self.stages.append((name, time.perf_counter() - began))
        return self.spark.read.parquet(at)

    def all_hits(self, questions: DataFrame, configs: list[RetrievalConfig], noted: bool = False) -> tuple[DataFrame, dict[str, str]]:
        """Hits (config, COMMON) of every configuration, one job after the other, so that no plan holds more than one. A failure is raised,
        unless errors are to be `noted`: then those of the configurations that failed are given beside the hits of the others.
        What configurations share is found once: passages of grep and kg for all strategies."""
        best: dict = {}
        kinds = {c.retriever for c in configs if c.transform == "none"}
        if "grep" in kinds and "grep" not in self.retrievers:
            best["grep"] = self.timed("grep", lambda: self._best_literal(questions))
        if "kg" in kinds and "kg" not in self.retrievers:
            best["kg"] = self.timed("kg", lambda: self._best_graph(questions))
        if found := [best[name].select("passage_id") for name in ("grep", "kg") if name in best]:
            ids = retrieve.sender(questions)(reduce(DataFrame.unionByName, found).distinct())
            best["texts"] = self.timed("texts", lambda: self.passages.select("passage_id", "text").join(ids, "passage_id", "left_semi"))
        depth = {name: max((c.depth * (3 if c.retriever == "hybrid" else 1) for c in configs if c.transform == "none" and c.retriever in (name, "hybrid")), default=0) for name in ("bm25", "dense")}
        if "hybrid" in self.retrievers:
            depth = dict.fromkeys(depth, 0)
        best |= self._scanned(questions, configs, depth)
        parts, errors = [], {}
        for c in configs:
            try:
                if c.transform == "none" and c.retriever in ("dense", "hybrid") and depth["dense"] and (c.strategy, "dense") not in best:  # for both
                    best[c.strategy, "dense"] = self.timed(f"{c.strategy}+dense list", lambda c=c: self._list("dense", questions, c.strategy, depth["dense"], {}))
                parts.append(self.timed(c.label, lambda c=c: self.retrieve(questions, c, best).select(F.lit(c.label).alias("config"), *COMMON)))
            except Py4JJavaError:  # the job itself failed, an executor was lost: no result of the configuration
                raise
            except Exception as e:
                if not noted:
                    raise
                errors[c.label] = f"{type(e).__name__}: {str(e)[:200]}"
        empty = self.spark.createDataFrame([], "config string, query_id long, chunk_id long, passage_id long, score double, rank int")
        return reduce(DataFrame.unionByName, parts, empty), errors

    def _scanned(self, questions: DataFrame, configs: list[RetrievalConfig], depth: dict[str, int]) -> dict[tuple[str, str], DataFrame]:
        """Lists by (strategy, bm25 or dense) that two passes over the texts give for all strategies, without an index."""
        strategies = dict.fromkeys(c.strategy for c in configs if c.transform == "none" and c.retriever in ("bm25", "hybrid"))
        if not depth["bm25"] or "bm25" in self.retrievers or not retrieve.few(questions):
            return {}
        cuts = {s: cut for s in strategies if (cut := self.store.cut(s))}
        if not cuts:
            return {}
        kinds = {"bm25": "bm25"} | ({"dense": "terms"} if getattr(self.retrievers.get("dense"), "by_terms", False) else {})
        made = self.timed("scan", lambda: scan.lists(questions, self.passages, cuts, max(depth.values()), self.settings.bm25_k1, self.settings.bm25_b, kinds=tuple(kinds.values())))
        return {(s, name): made.where((F.col("strategy") == s) & (F.col("kind") == kind)).drop("strategy", "kind") for s in cuts for name, kind in kinds.items()}

    def results(self, configs: list[RetrievalConfig], questions: DataFrame | None = None, noted: bool = False) -> tuple[DataFrame, dict[str, str]]:
        """Metrics (config, query_id, ...) of each question under each configuration, and errors by configuration (`all_hits`). Questions
        of a configuration that failed have a row without metrics: a failure is no score."""
        questions = tables.questions(self.spark, self.sf_dir) if questions is None else questions
        gold = self.store.table("qrels", lambda: tables.qrels(tables.questions(self.spark, self.sf_dir), self.passages))
        labels = self.spark.createDataFrame([(c.label,) for c in configs], "config string")
        asked = questions.select("query_id").crossJoin(F.broadcast(labels))  # a row for each configuration
        hits, errors = self.all_hits(questions, configs, noted)
        each = metrics.question_metrics(hits, gold, asked, by=("config", "query_id"))
        if errors:
            each = each.withColumns({c: F.when(~F.col("config").isin(list(errors)), F.col(c)) for c in each.columns if c not in ("config", "query_id", "n_gold")})
        return each, errors

    def evaluate(self, configs: list[RetrievalConfig], questions: DataFrame | None = None, noted: bool = False) -> DataFrame:
        """Mean metrics by configuration over the folder's questions and their gold passages. A failure is raised; with `noted`, it is in
        `error` and the configuration has no metrics."""
        each, errors = self.results(configs, questions, noted)
        parts = self.spark.createDataFrame([(c.label, c.strategy, c.retriever, c.transform, c.rerank, c.expansion, errors.get(c.label)) for c in configs], "config string, strategy string, retriever string, transform string, rerank boolean, expansion string, error string")
        means = metrics.means(each, ["config"], METRICS)
        return means.join(F.broadcast(parts), "config").withColumn("errors", F.when(F.col("error").isNotNull(), F.col("n")).otherwise(0))  # a row for each configuration
