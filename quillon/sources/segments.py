"""A lexical index kept up by segments: changes add to it, and what they do not touch is not written again.

* A *segment* is immutable: the postings of the units that one change brought, by bucket of their term, and its units
  (chunk_id, dl, terms).
* A changed or deleted unit leaves a *tombstone* (segment, chunk_id) in the segment that had it.
* Document frequencies and the two sums behind the mean length are *additive*: a change appends the counts of its new units
  and, negative, those of its tombstones, whose terms come from the units' rows, not from the postings.
* A *version* is a small JSON file that names segments, tombstones and counts. It becomes current by one rename that never
  replaces a file: of two writers that began from one version the second fails with `Conflict` and has changed nothing.
  A reader keeps the version that it opened; nothing that a version names is changed or deleted until `vacuum`.
* `merge` joins the smallest segments, those within a factor `fan` of each other, once there are `fan` of them: their
  live postings become one segment, and their tombstones go. So there are about `fan` segments for each power of `fan`.

Units are (chunk_id, passage_id, text). A chunk_id occurs once in a change; of repeated rows the largest (passage_id, text)
counts. Null and empty texts are units of no terms, which count for N and the mean length. Null chunk_ids are refused. Deleting
what is not there does nothing. Very long texts are one row of units, as they are in `operators.index`.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import index
from .files import commit, discard, listed, written

COUNTS = "term string, df long"
UNITS = "chunk_id long, passage_id long, dl int, terms array<string>"
POSTINGS = "term string, chunk_id long, passage_id long, dl int, n_terms int, tf long, bucket int"
DEAD = "segment string, chunk_id long"


SENT = 2_000_000  # tombstones of a segment, eight bytes each, that go to all tasks


class Conflict(RuntimeError):
    """Another writer has committed the next version."""


class Segments:
    """The index in the folder `path`, as of its latest version or of `version`."""

    def __init__(self, spark: SparkSession, path: str, stop: list[str] | None = None, version: int | None = None) -> None:
        self.spark, self.path, self.stop = spark, path.rstrip("/"), stop
        names = listed(spark, f"{self.path}/versions")
        self.version = version if version is not None else max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)
        self.state: dict = {"segments": {}, "dead": [], "counts": [], "n": 0, "length": 0}
        if self.version:
            lines = spark.read.text(f"{self.path}/versions/{self.version:08d}.json", wholetext=True)
            self.state = json.loads(lines.first()[0])

    def _write(self, df: DataFrame, kind: str, by: tuple[str, ...] = ()) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        self._stored(df, kind, name, by)
        return name

    def _stored(self, df: DataFrame, kind: str, name: str, by: tuple[str, ...] = ()) -> None:
        """Rows are written where they are made, so that they do not move."""
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{kind}/{name}")

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        """The tables `names`, with `segment`, the name of each row's table."""
        if not names:
            return self.spark.createDataFrame([], schema + ", segment string" * (kind in ("units", "postings")))
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{n}") for n in names]
        if kind in ("units", "postings"):
            each = [df.withColumn("segment", F.lit(n)) for df, n in zip(each, names, strict=True)]
        return reduce(DataFrame.unionByName, each)

    def _commit(self, state: dict) -> Segments:
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(attempt)
        part = next(n for n in listed(self.spark, attempt) if n.startswith("part-"))
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
        if not commit(self.spark, f"{attempt}/{part}", f"{self.path}/versions/{self.version + 1:08d}.json"):
            raise Conflict(f"version {self.version + 1} is another writer's")
        return Segments(self.spark, self.path, self.stop, self.version + 1)

    @property
    def names(self) -> list[str]:
        return sorted(self.state["segments"])

    def units(self) -> DataFrame:
        """(chunk_id, passage_id, dl, terms, segment) of the live units."""
        return self._living("units", self.names, UNITS)

    def _living(self, kind: str, names: list[str], schema: str) -> DataFrame:
        """The rows of the tables `names` whose units have no tombstone. A segment's tombstones go to its rows, if they are few enough."""
        if not names or not self.state["dead"]:
            return self._read(kind, names, schema)
        dead = self._read("dead", self.state["dead"], DEAD)
        sizes = {r["segment"]: r["count"] for r in dead.groupBy("segment").count().collect()}  # a row for each segment

        def living(name: str) -> DataFrame:
            rows, own = self._read(kind, [name], schema), dead.where(F.col("segment") == name).select("chunk_id")
            return rows.join(F.broadcast(own) if sizes[name] <= SENT else own, "chunk_id", "left_anti") if name in sizes else rows

        return reduce(DataFrame.unionByName, [living(n) for n in names])

    def _segment(self, tokenised: DataFrame) -> tuple[str, DataFrame, int, int]:
        """Writes a segment of (chunk_id, passage_id, tokens); its name, units, their number and summed length."""
        name = f"segment-{uuid.uuid4().hex}"
        rows = tokenised.select("chunk_id", "passage_id", F.size("tokens").alias("dl"), F.array_distinct("tokens").alias("terms"))
        self._stored(rows, "units", name)
        postings = index.postings(tokenised).withColumn("bucket", index.bucket(F.col("term")))
        self._stored(postings, "postings", name, ("bucket",))
        units = self.spark.read.schema(UNITS).parquet(f"{self.path}/units/{name}")
        n, length = units.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return name, units, n, length

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Segments:
        """The next version, with `upserts` (chunk_id, passage_id, text) in place of the units of their ids, and without `deletes` (chunk_id)."""
        state = json.loads(json.dumps(self.state))
        gone, tokenised, scratch = [], None, []

        def once(df: DataFrame, label: str) -> DataFrame:
            """`df`, written until the change is committed."""
            scratch.append(written(df, label))
            return scratch[-1]

        if upserts is not None:
            if not upserts.where("chunk_id is null").isEmpty():
                raise ValueError("units need a chunk_id")
            one = upserts.groupBy("chunk_id").agg(F.max(F.struct("passage_id", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("chunk_id", "x.*")
            tokenised = once(index.lengths(one, self.stop), "segment-tokens")
            gone.append(tokenised.select("chunk_id"))
        if deletes is not None:
            gone.append(deletes.select("chunk_id").where("chunk_id is not null"))
        if gone and self.names:
            ids = reduce(DataFrame.unionByName, gone).distinct()
            dead = once(self.units().join(ids, "chunk_id", "left_semi"), "segment-dead")
            n, length = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if n:
                state["dead"].append(self._write(dead.select("segment", "chunk_id"), "dead"))
                state["counts"].append(self._write(dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")), "counts"))
                for r in dead.groupBy("segment").agg(F.count("*").alias("n")).collect():  # a row for each segment
                    state["segments"][r["segment"]] -= r["n"]
                state["n"], state["length"] = state["n"] - n, state["length"] - length
        if tokenised is not None and not tokenised.isEmpty():
            name, units, n, length = self._segment(tokenised)
            state["segments"][name] = n
            state["counts"].append(self._write(units.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "counts"))
            state["n"], state["length"] = state["n"] + n, state["length"] + length
        state["segments"] = {k: v for k, v in state["segments"].items() if v}
        made = self._commit(state)
        for df in scratch:
            discard(df)
        return made

    def due(self, fan: int = 4) -> list[str]:
        """The segments that `merge` would join: the smallest tier (sizes within a factor `fan`) of `fan` segments or more."""
        tiers: dict[int, list[str]] = {}
        for name, n in sorted(self.state["segments"].items(), key=lambda x: (x[1], x[0])):
            tier, size = 0, n
            while size >= fan:
                tier, size = tier + 1, size // fan
            tiers.setdefault(tier, []).append(name)
        return next((names for _, names in sorted(tiers.items()) if len(names) >= fan), [])

    def merge(self, fan: int = 4) -> Segments:
        """The next version, with the segments that are due as one, or this one if none are. Rows found stay the same."""
        names = self.due(fan)
        if not names:
            return self
        state = json.loads(json.dumps(self.state))
        name = f"segment-{uuid.uuid4().hex}"
        self._stored(self._living("units", names, UNITS).drop("segment"), "units", name)
        self._stored(self._living("postings", names, POSTINGS).drop("segment"), "postings", name, ("bucket",))
        state["segments"] = {k: v for k, v in state["segments"].items() if k not in names} | {name: sum(state["segments"][k] for k in names)}
        if state["dead"]:
            left = self._read("dead", state["dead"], DEAD).where(F.col("segment").isin(list(state["segments"])))
            state["dead"] = [] if left.isEmpty() else [self._write(left, "dead")]
        state["counts"] = [self._write(self._counts(), "counts")]
        return self._commit(state)

    def _counts(self) -> DataFrame:
        return self._read("counts", self.state["counts"], COUNTS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def lexical(self) -> index.Lexical:
        """The index as `retrieve.bm25_indexed` takes it. Buckets of terms are pruned in every segment."""
        postings = self._living("postings", self.names, POSTINGS).drop("segment")
        mean = self.state["length"] / self.state["n"] if self.state["n"] else None
        return index.Lexical(postings, self._counts(), self.spark.createDataFrame([(self.state["n"], mean)], "n long, avgdl double"))

    def vacuum(self) -> list[str]:
        """Deletes what the current version does not name, older versions too; the names that went. For when no reader has
        an older version open and no writer is at work."""
        keep = {*self.names, *self.state["dead"], *self.state["counts"], f"{self.version:08d}.json"}
        gone = [(kind, n) for kind in ("units", "postings", "dead", "counts", "versions", "attempts") for n in listed(self.spark, f"{self.path}/{kind}") if n not in keep]
        for kind, name in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{name}")
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return [n for _, n in gone]
