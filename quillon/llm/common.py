"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and everything runs on this
    machine (tests), a folder of our own; on a cluster no folder of one machine may take its place."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_kept: list[list[str]] = []  # folders written in each open `scratch`


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _kept:
        _kept[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `stored` writes within goes at the end: for results that are written within, too."""
    _kept.append([])
    try:
        yield
    finally:
        for path in _kept.pop():
            remove(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the files of tables made by `stored`, once nothing reads them any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names as working columns that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"__{name}{i or ''}") not in taken) for name in names]


def meet(rows: DataFrame, groups: DataFrame, on: list[str], n: str, spread_by: str | list[str], total: int, how: str = "inner", steady: bool = False) -> DataFrame:
    """`rows` joined with `groups`, which has one row for each value of `on` and its number `n` of rows. `n` goes.

    A group with more than an eighth of a task's share is salted by its count: its rows are dealt to as many parts by
    `spread_by`, each of which meets a copy of the group's row. At most 8 * tasks groups are so large, as `total` rows hold
    no more, so their list is broadcast. With `steady` it has a row without a key besides, and the plan is the same whether
    there are large groups or none.
    """
    limit = max(1000, total // (8 * parallelism(rows.sparkSession)))
    parts = F.ceil(F.col(n) / F.lit(limit)).cast("int")
    large = groups.where(F.col(n) > limit).select(*on, parts.alias("__parts"))
    if steady:
        large = large.unionByName(rows.sparkSession.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in on], F.lit(1).alias("__parts")))
    dealt = rows.join(F.broadcast(large), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*([spread_by] if isinstance(spread_by, str) else spread_by)), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return dealt.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
