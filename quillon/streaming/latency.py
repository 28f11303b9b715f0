"""Latency of run-log rows by time window, on a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Run-log rows from Parquet files as they arrive in `path`."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_at_once).parquet(path)


def latency(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, source, n, sum_ms, max_ms) by window; in a stream, rows later than `late` are dropped and a window is emitted
    once it has ended."""
    made = log.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("event_type").alias("source"))
    rows = made.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("sum_ms"), F.max("value").alias("max_ms"))
    return rows.select(F.col("window.start").alias("start"), "source", "n", "sum_ms", "max_ms")
