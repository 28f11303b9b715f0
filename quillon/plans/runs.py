"""Evaluation runs: a header that goes from running to done, results by question, files for people, and their listing."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RetrievalConfig
from ..functions import text as tx
from ..operators import metrics
from ..sources import schema, tables
from .engine import METRICS, Engine

SHOWN = ("recall_5", "recall_10", "precision_5", "mrr", "ndcg_10", "hit_5", "errors", "seconds")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _header(spark: SparkSession, root: str, row: dict) -> None:
    write_text(spark, f"{root}/eval_runs/{row['id']}/header.json", json.dumps(row))


def _csv(rows: list[dict], names: list[str]) -> str:
    cell = lambda v: "" if v is None else str(v)  # noqa: E731  no value has a comma
    return "\n".join([",".join(names), *(",".join(cell(r[n]) for n in names) for r in rows)]) + "\n"


def report(name: str, run_id: str, n_questions: int, rows: list[dict]) -> str:
    """A table of the configurations by recall at 10, and recall at 10 by strategy and retriever for those without layers."""
    number = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# Retrieval run {name}", "", f"{n_questions} questions, {len(rows)} configurations, run `{run_id}`. Hits are counted by passage.", "", "| config | " + " | ".join(SHOWN) + " |", "|" + "-|" * (len(SHOWN) + 1)]
    for r in sorted(rows, key=lambda r: (-(r["recall_10"] or 0), r["config"])):
        lines.append(f"| {r['config']} | " + " | ".join(number(r[c]) for c in SHOWN) + " |")
    plain = [r for r in rows if r["transform"] == "none" and not r["rerank"] and r["expansion"] == "none"]
    strategies, retrievers = (list(dict.fromkeys(r[c] for r in plain)) for c in ("strategy", "retriever"))
    if len(strategies) > 1 and len(retrievers) > 1:
        at = {(r["strategy"], r["retriever"]): r["recall_10"] for r in plain}
        lines += ["", "| recall_10 | " + " | ".join(retrievers) + " |", "|" + "-|" * (len(retrievers) + 1)]
        lines += [f"| {s} | " + " | ".join(number(at.get((s, r))) for r in retrievers) + " |" for s in strategies]
    return "\n".join(lines) + "\n"


def evaluate(engine: Engine, configs: list[RetrievalConfig], root: str, name: str, eval_set: str = "all", questions: DataFrame | None = None) -> str:
    """Run configurations under `root`; the run's id. Files of the run: per_config.csv, per_question.csv (a folder of parts),
    summary.json, report.md. Its rows: eval_results and query_logs. A run that dies stays `running`."""
    spark = engine.spark
    questions = tables.questions(spark, engine.sf_dir) if questions is None else questions
    n, began = questions.count(), datetime.now(UTC)
    header = {"id": uuid.uuid4().hex, "created_at": began.isoformat(), "finished_at": None, "name": name, "kind": "retrieval", "eval_set": eval_set, "n_questions": n, "status": "running", "config": json.dumps([c.label for c in configs]), "summary": None}
    _header(spark, root, header)
    engine.stages.clear()
    each, errors = engine.results(configs, questions, noted=True)
    at = f"{root}/eval_runs/{header['id']}"
    each = each.join(questions.select("query_id", tx.question_type(F.col("query_text")).alias("question_type")), "query_id")
    each.write.option("header", True).csv(f"{at}/per_question.csv")
    seconds = dict(engine.stages)
    shown = [c for c in METRICS if c != "mrr"]
    results = each.select(F.lit(header["id"]).alias("run_id"), "query_id", "config", F.to_json(F.struct("mrr", *shown, "n_gold", "n_passages", "first_gold_rank")).alias("metrics"))
    failed = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair]) if errors else F.lit(None).cast("map<string,string>")
    results = results.withColumns({c: F.lit(None).cast(t) for c, t in (("retrieved", "array<long>"), ("answer", "string"), ("latency_ms", "long"), ("query_log_id", "string"))}).withColumn("error", F.try_element_at(failed, "config"))
    results.select(schema.schema_of("eval_results").names).write.mode("append").parquet(f"{root}/eval_results")
    logs = each.join(questions, "query_id").select("query_id", F.col("query_text").alias("question"), F.lit("eval").alias("source"), F.struct("config").alias("config"), F.struct("mrr", "recall_10").alias("metrics"), F.try_element_at(failed, "config").alias("error"))
    schema.append_log(logs, f"{root}/query_logs")
    means = {r["config"]: r.asDict() for r in metrics.means(each, ["config"], METRICS).collect()}  # a row for each configuration
    rows = []
    for c in configs:
        spent = round(seconds.get(c.label, 0.0), 1)
        rows.append({**{m: None for m in ("n", *METRICS)}, **means.get(c.label, {}), "config": c.label, "strategy": c.strategy, "retriever": c.retriever, "transform": c.transform, "rerank": c.rerank, "expansion": c.expansion, "errors": n if c.label in errors else 0, "seconds": spent})
    write_text(spark, f"{at}/per_config.csv", _csv(rows, ["n", *METRICS, "config", "strategy", "retriever", "transform", "rerank", "expansion", "errors", "seconds"]))
    summary = {"run_id": header["id"], "name": name, "eval_set": eval_set, "n_questions": n, "created": header["created_at"], "configs": rows}
    write_text(spark, f"{at}/summary.json", json.dumps(summary, indent=1))
    write_text(spark, f"{at}/report.md", report(name, header["id"], n, rows))
    _header(spark, root, {**header, "status": "done", "finished_at": datetime.now(UTC).isoformat(), "summary": json.dumps({"configs": rows})})
    return header["id"]


def listed(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Headers of all runs, the latest first."""
    rows = spark.read.schema(schema.SCHEMAS["eval_runs"]).json(f"{root}/eval_runs/*/header.json")
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy(F.desc("created_at"), "id")


def largest(runs: DataFrame, size: str) -> DataFrame:
    """The run with the most configurations (`size`), the latest of ties: one row."""
    return runs.orderBy(F.desc(size), F.desc("created_at"), "id").limit(1)


def largest_retrieval(spark: SparkSession, root: str) -> DataFrame:
    done = listed(spark, root, "retrieval").where("status = 'done'")
    return largest(done.withColumn("n_configs", F.size(F.from_json("config", "array<string>"))), "n_configs")


def with_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results (query_id, ...) with each question's text and type; results of unknown questions go."""
    return results.join(questions.select("query_id", F.col("query_text").alias("question"), tx.question_type(F.col("query_text")).alias("question_type")), "query_id")


def results_of(spark: SparkSession, root: str, run_id: str, questions: DataFrame) -> DataFrame:
    return with_questions(schema.read(spark, root, "eval_results").where(F.col("run_id") == run_id), questions)


def write_eval_set(spark: SparkSession, sample: DataFrame, path: str, most: int = 10_000) -> int:
    """An evaluation set as one JSON file, in order of id; how many questions it has. Sets of more than `most` are refused."""
    rows = [r.asDict() for r in sample.orderBy("id").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"an evaluation set has at most {most} questions")
    write_text(spark, path, json.dumps(rows, indent=1, default=str))
    return len(rows)
