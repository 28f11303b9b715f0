"""The engine's own tables: their schemas, creation and reset, the run log, and a listing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Every table that the engine writes, by name.
SCHEMAS: dict[str, str] = {
    "passages": "passage_id long, text string, n_chars int, n_words int, n_tokens int, sentence_offsets array<int>, entities array<string>",
    "questions": "query_id long, question string, answer string, relevant array<long>, n_gold_total int, question_type string",
    "corpus_meta": "key string, value string, updated_at timestamp",
    "eval_sets": "name string, query_id long, position int",
    "chunk_strategies": "name string, description string, params string, embedding_model string, embedding_dim int, n_chunks long, avg_tokens double, built_at timestamp",
    "chunks": "chunk_id long, strategy string, passage_id long, chunk_index int, char_start int, char_end int, n_tokens int, prefix string, embedding array<float>",
    "entities": "name string, doc_freq long, passage_ids array<long>",
    "query_logs": "id string, created_at timestamp, source string, question string, query_id long, config string, stages string, retrieved string, answer string, citations string, "
    "metrics string, latency_ms long, tokens string, trace_provider string, trace_id string, trace_url string, error string",
    "eval_runs": "id string, created_at timestamp, finished_at timestamp, name string, kind string, eval_set string, n_questions long, status string, config string, summary string",
    "eval_results": "run_id string, query_id long, config string, metrics string, retrieved array<long>, answer string, latency_ms long, query_log_id string, error string",
}
JSON_COLUMNS = ("config", "stages", "retrieved", "citations", "metrics", "tokens")


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def apply(spark: SparkSession, root: str, reset: bool = False) -> list[str]:
    """Create the tables that are missing under `root`, empty; with `reset`, all of them anew. Names of those created."""
    made = []
    for name in SCHEMAS:
        fs, path = _path(spark, f"{root}/{name}")
        if reset or not fs.exists(path):
            spark.createDataFrame([], schema_of(name)).write.mode("overwrite").parquet(f"{root}/{name}")
            made.append(name)
    return made


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema_of(name)).parquet(f"{root}/{name}")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(name, n_rows, bytes) of the tables under `root`. Rows come from the files' footers."""
    rows = []
    for name in SCHEMAS:
        fs, path = _path(spark, f"{root}/{name}")
        if fs.exists(path):
            rows.append((name, read(spark, root, name).count(), fs.getContentSummary(path).getLength()))
    return spark.createDataFrame(rows, "name string, n_rows long, bytes long")


def log_rows(rows: DataFrame) -> DataFrame:
    """Run-log rows in the log's schema: missing columns are null, an id and the time are given where there is none, nested
    columns become JSON, and hits of evaluations lose their text."""
    if "retrieved" in rows.columns and "array<struct" in dict(rows.dtypes)["retrieved"] and "text" in rows.schema["retrieved"].dataType.elementType.names:
        bare = F.transform("retrieved", lambda h: F.when(F.col("source") == "eval", h.withField("text", F.lit(None).cast("string"))).otherwise(h))
        rows = rows.withColumn("retrieved", bare if "source" in rows.columns else F.col("retrieved"))
    out = []
    for field in schema_of("query_logs"):
        if field.name not in rows.columns:
            value = F.lit(None)
        elif field.name in JSON_COLUMNS and dict(rows.dtypes)[field.name] != "string":
            value = F.to_json(field.name)
        else:
            value = F.col(field.name)
        out.append(value.cast(field.dataType).alias(field.name))
    made = rows.select(*out)
    given = F.sha2(F.concat_ws(":", F.lit(uuid.uuid4().hex), F.xxhash64(*[c for c in made.columns if c != "id"]).cast("string"), F.monotonically_increasing_id().cast("string")), 256)
    return made.withColumns({"id": F.coalesce("id", F.left(given, F.lit(32))), "created_at": F.coalesce("created_at", F.current_timestamp()), "source": F.coalesce("source", F.lit("api"))})


def append_log(rows: DataFrame, path: str, strict: bool = False) -> bool:
    """Append run-log rows, one or many; unless `strict`, a failure is reported and never stops the caller."""
    try:
        log_rows(rows).write.mode("append").parquet(path)
        return True
    except Exception:
        if strict:
            raise
        return False


def load_once(spark: SparkSession, df: DataFrame, path: str, replace: bool = False) -> bool:
    """Write a table unless it has rows already; with `replace` always. Whether it was written."""
    fs, at = _path(spark, path)
    if not replace and fs.exists(at) and not spark.read.schema(df.schema).parquet(path).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
