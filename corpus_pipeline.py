"""The training-data pipeline: documents in, packed sequences out.

Each stage reads what its predecessor kept, as Parquet, and its decisions take effect: toxic documents go, of equal
texts one stays, of each near-duplicate group one stays, the rest is repeated or left out as the mix wants it, and
what is left is packed. All stages but the last return the columns of their input, whatever their names.

Null and empty texts are clean (they score as the prior), equal to each other, no near copies of anything, of no tokens (so
the mix leaves them out) and would be packed as their end id alone. Of rows repeated with one doc_id, the stages of copies
keep one where the texts are equal and all where they are not; the mix shares out what it takes of them. Ties are decided by
doc_id. Very long texts are processed whole in every stage. An empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from quillon.llm.common import remove, scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_only(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup_keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, max_segments=6, prompt_line=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written to the shared folder and read again. What a stage wrote on
    its way goes when its result is written, and a result when the next one is."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, f"{at}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither training nor near-duplicate groups; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None
