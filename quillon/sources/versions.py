"""Tables that change: every change is a new version, in which only the partitions that hold changed keys are written anew.

Rows are dealt to `buckets` partitions by a hash of the key. A version is a small JSON file that names the folder of each
partition; it becomes current by one rename that never replaces a file, so of two writers that began from one version the second
fails with `Conflict` and has changed nothing. A reader keeps the version that it opened. The files of older versions stay
until `vacuum`.

Keys are unique: of rows given with one key the last by `order` (all columns, by default) counts, and null keys are refused. A
change with no rows makes a version that names the same folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .files import commit, listed, written
from .segments import Conflict


class Versions:
    """The table in the folder `path`, as of its latest version or of `version`."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        names = listed(spark, f"{self.path}/versions")
        self.version = version if version is not None else max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)
        if not self.version:
            raise FileNotFoundError(f"{path} has no version; use Versions.create")
        state = json.loads(spark.read.text(f"{self.path}/versions/{self.version:08d}.json", wholetext=True).first()[0])
        self.key, self.buckets, self.parts = state["key"], state["buckets"], {int(k): v for k, v in state["parts"].items()}
        self.schema = StructType.fromJson(state["schema"])

    @staticmethod
    def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> Versions:
        """Version 1 of a table: `rows`, by `key`. Fails with `Conflict` if there is one already."""
        spark, path = rows.sparkSession, path.rstrip("/")
        state = {"key": key, "buckets": buckets, "parts": {}, "schema": json.loads(rows.schema.json())}
        state["parts"] = _dealt(rows, path, key, buckets)
        return _commit(spark, path, 0, state)

    def _bucket(self, key: str) -> Column:
        return _bucket(key, self.buckets)

    def read(self) -> DataFrame:
        """All rows of this version."""
        return self._partitions(sorted(self.parts))

    def _partitions(self, buckets: list[int]) -> DataFrame:
        paths = [self.parts[b] for b in buckets if b in self.parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; only their partitions are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        held = [r[0] for r in wanted.select(self._bucket(self.key)).distinct().collect()]
        return self._partitions(held).where(F.col(self.key).isin(keys))

    def _change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> Versions:
        """The next version: `make` gets the rows of the partitions that hold any of `keys`, and gives those partitions' new rows."""
        touched = sorted(r[0] for r in keys.select(self._bucket(self.key)).distinct().collect())  # `buckets` numbers at most
        parts = {b: p for b, p in self.parts.items() if b not in touched}
        if touched:
            parts |= _dealt(make(self._partitions(touched)).select(*self.schema.names), self.path, self.key, self.buckets)
        state = {"key": self.key, "buckets": self.buckets, "parts": parts, "schema": json.loads(self.schema.json())}
        return _commit(self.spark, self.path, self.version, state)

    def upsert(self, rows: DataFrame) -> Versions:
        """`rows` in place of those of their keys, or beside them."""
        rows = written(_unique(rows.select(*self.schema.names), self.key), "upsert")
        return self._change(rows, lambda old: old.join(rows, self.key, "left_anti").unionByName(rows))

    def insert_ignore(self, rows: DataFrame) -> Versions:
        """`rows` whose keys are not there yet. Partitions in which nothing is new are not written."""
        rows = _unique(rows.select(*self.schema.names), self.key)
        new = written(rows.join(self.read().select(self.key), self.key, "left_anti"), "insert")
        return self._change(new, lambda old: old.unionByName(new))

    def delete(self, keys: DataFrame) -> Versions:
        """Without the rows whose key is in `keys` (a column of the key's name)."""
        keys = written(keys.select(self.key).distinct().join(self.read().select(self.key), self.key, "left_semi"), "delete")
        return self._change(keys, lambda old: old.join(keys, self.key, "left_anti"))

    def delete_where(self, wrong: Column) -> Versions:
        """Without the rows for which `wrong` is true."""
        return self.delete(self.read().where(wrong).select(self.key))

    def update(self, values: DataFrame) -> Versions:
        """With the columns of `values` (the key and some others) in place of those of its keys; other keys are ignored."""
        names = [c for c in values.columns if c != self.key]
        values = written(_unique(values, self.key).join(self.read().select(self.key), self.key, "left_semi"), "update")

        def make(old: DataFrame) -> DataFrame:
            new = values.select(self.key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__hit"))
            met = old.join(new, self.key, "left")
            return met.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}").cast(self.schema[c].dataType)).otherwise(F.col(c)) for c in names})

        return self._change(values, make)

    def truncate(self) -> Versions:
        """Without any row."""
        return _commit(self.spark, self.path, self.version, {"key": self.key, "buckets": self.buckets, "parts": {}, "schema": json.loads(self.schema.json())})

    def vacuum(self) -> list[str]:
        """Deletes what this version does not name; the folders and files that went."""
        keep = {p.split("/")[1] for p in self.parts.values()} | {f"{self.version:08d}.json"}
        gone = [f"{kind}/{n}" for kind in ("data", "versions", "attempts") for n in listed(self.spark, f"{self.path}/{kind}") if n not in keep]
        for name in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return gone


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")


def _unique(rows: DataFrame, key: str) -> DataFrame:
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows need a {key}")
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("__last")).select(key, "__last.*")


def _dealt(rows: DataFrame, path: str, key: str, buckets: int) -> dict[int, str]:
    """Writes `rows` by bucket into a folder of their own; the folder of each bucket that has rows."""
    name = f"data/{uuid.uuid4().hex}"
    rows.withColumn("__bucket", _bucket(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{name}")
    return {int(n.split("=")[1]): f"{name}/{n}" for n in listed(rows.sparkSession, f"{path}/{name}") if n.startswith("__bucket=")}


def _commit(spark: SparkSession, path: str, version: int, state: dict) -> Versions:
    attempt = f"{path}/attempts/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(attempt)
    part = next(n for n in listed(spark, attempt) if n.startswith("part-"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
    if not commit(spark, f"{attempt}/{part}", f"{path}/versions/{version + 1:08d}.json"):
        raise Conflict(f"version {version + 1} is another writer's")
    return Versions(spark, path, version + 1)
