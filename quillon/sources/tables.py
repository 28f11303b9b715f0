"""Relations of the engine, bound to Parquet tables, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .store import Store


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, below: int = 512 << 20) -> DataFrame:
    """`df` dealt to all cores by a hash of `key` if its source has less than `below` bytes (by the file sizes, which the
    planner knows): a small table is often one file with one row group, which one task would read and everything after
    it. Larger ones have tasks enough and stay as they are read. The rows are the same either way."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if size < below else df


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage_id, text, lang, source): documents with normalised text, none of them blank."""
    # What is blank once normalised has no other sign; that is seen at the first one, without normalising the text for it.
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where(F.rlike("text", F.lit(r"(?U)\S")))
    return spread(docs, "doc_id").select(F.col("doc_id").alias("passage_id"), tx.normalise(F.col("text")).alias("text"), "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text)."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.normalise(F.col("text")).alias("query_text"))


KEY_WORDS = 4  # successive words by which a question and a passage meet


def qrels(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage_id): passages that contain the question's text verbatim.

    The inner words of a question (all but the first and last, which may end within a word of the passage) stand in the
    passage as they are, so the two meet by a hash of four of them in an equi join, or of one where there are fewer. Only ids and keys
    meet; the text of a passage is fetched once for each question that shares its key, and compared. Questions of one or two
    words have no inner word: they are compared with every passage, if there are no more than `small` takes.
    """
    words = F.split("query_text", " ")
    asked = questions.select("query_id", "query_text", words.alias("w"))
    n = F.size("w")
    long = asked.where(n >= KEY_WORDS + 2).select("query_id", F.xxhash64(*[F.element_at("w", i) for i in range(2, KEY_WORDS + 2)]).alias("key"))
    middle = asked.where(n.between(3, KEY_WORDS + 1)).select("query_id", F.xxhash64(F.element_at("w", 2)).alias("key"))
    split = passages.select("passage_id", F.split("text", " ").alias("w"))
    # Successive words as a generated row each, in generated code; a passage has few keys that any question has.
    at = split.select("passage_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    keyed = at.where(F.size("w") >= F.col("i") + (KEY_WORDS - 1)).select("passage_id", F.xxhash64(*[F.element_at("w", F.col("i") + j) for j in range(KEY_WORDS)]).alias("key"))
    met = keyed.join(small(long), "key").select("query_id", "passage_id").distinct()
    if not middle.isEmpty():
        single = at.select("passage_id", F.xxhash64(F.element_at("w", F.col("i"))).alias("key"))
        met = met.unionByName(single.join(small(middle), "key").select("query_id", "passage_id").distinct())
    found = met.join(passages.select("passage_id", "text"), "passage_id").join(small(questions.select("query_id", "query_text")), "query_id")
    found = found.where(F.contains("text", F.col("query_text"))).select("query_id", "passage_id")
    short = asked.where(n < 3).select("query_id", "query_text")
    if short.isEmpty():
        return found
    return found.unionByName(passages.select("passage_id", "text").join(small(short), F.contains("text", F.col("query_text"))).select("query_id", "passage_id"))


_STORES: dict[tuple, Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a folder's passages. While the files of the table stay the same, their content is not read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = Store(passages(spark, sf_dir))
    return _STORES[key]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def write_partitioned(df: DataFrame, path: str, by: str, replace: bool = False) -> None:
    """Write by partition of `by`. Without `replace` an existing table stays as it is; with it, only the partitions in
    `df` are replaced."""
    if replace:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    else:
        df.write.mode("ignore").partitionBy(by).parquet(path)


