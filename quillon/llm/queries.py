"""The queries of this subpackage: one for each operator, over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import divergence, exact_dedup, fingerprints, hmm_lm, mixing, near_dedup, packing, prefix_trie, quality, repeats, secrets, token_counts, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as instruction data: the first of several lines asks, the rest answers and bears the loss."""
    return packing.pack(table(spark, sf_dir, "documents"), max_segments=6, prompt_line=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).totals()


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_texts(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_scores(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out=0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.lm_scores(table(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_near_dedup": op2_near_dedup, "op3_packing": op3_packing, "op4_exact_dedup": op4_exact_dedup, "op5_secrets": op5_secrets, "op6_token_counts": op6_token_counts, "op7_fingerprints": op7_fingerprints, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_lm_scores": op10_lm_scores, "op11_repeats": op11_repeats, "op12_divergence": op12_divergence, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.SQL, "op6_token_counts": token_counts.SQL, "op12_divergence": divergence.SQL, "op13_prefix_trie": prefix_trie.SQL}
