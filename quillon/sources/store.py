"""What is derived from a corpus and kept: chunks, postings, edges, each built once and found again by the corpus's content.

A corpus's key is its number of passages and a checksum of their ids and texts, so any edit makes another key, and an index
that belongs to another state of the corpus is never read (a count alone would miss edits that keep it). A table is written
to a folder of its own and then renamed to its name, which is the commit; of two builders one wins.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from ..operators import chunking, index
from .files import commit, shared_folder


def content_key(passages: DataFrame) -> str:
    """Number of rows and checksum of ids and texts."""
    n, x, y = passages.agg(F.count("*"), F.bit_xor(F.xxhash64("passage_id", "text")), F.bit_xor(F.hash("text", "passage_id"))).first()
    return f"{n}-{(x or 0) & (1 << 64) - 1:016x}{(y or 0) & (1 << 32) - 1:08x}"


class Store:
    """Tables derived from `passages` (passage_id, text), under a folder that driver and executors share."""

    def __init__(self, passages: DataFrame, path: str | None = None) -> None:
        self.spark, self.passages = passages.sparkSession, passages
        self.path = (path or f"{shared_folder(self.spark)}/store").rstrip("/")
        self.key = content_key(passages)
        self.n = int(self.key.split("-")[0])

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def table(self, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        """The table `name` of this corpus; `make` builds it if this state of the corpus has none yet."""
        at = f"{self.path}/{self.key}/{name}"
        path = self._path(f"{at}/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
            writer = make().write
            (writer.partitionBy(*by) if by else writer).parquet(attempt)
            fs.mkdirs(self._path(f"{self.path}/{self.key}"))
            if not commit(self.spark, attempt, at):
                fs.delete(self._path(attempt), True)  # another builder was first
        return self.spark.read.parquet(at)

    def prune(self) -> list[str]:
        """Deletes the tables of other states of the corpus and unfinished attempts; the keys that went. For when no reader
        has them open and no builder is at work."""
        root = self._path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        gone = [f.getPath().getName() for f in fs.listStatus(root) if f.getPath().getName() != self.key] if fs.exists(root) else []
        for name in gone:
            fs.delete(self._path(f"{self.path}/{name}"), True)
        return sorted(gone)

    @functools.cached_property
    def threshold(self) -> float:
        """Where semantic breaks are, found once."""
        return chunking.calibrated(self.passages)

    def cut(self, strategy: str) -> chunking.Cut | None:
        """The cut of a strategy, for texts that are cut where they are; None for windows of tokens and what `chunking.chunker` does not know."""
        kind, *sizes = strategy.split("_")
        if len(sizes) != {"passage": 0, "sentence": 0, "semantic": 0, "fixed": 2, "recursive": 2}.get(kind):
            return None
        return chunking.cut_of(strategy, self.threshold if strategy == "semantic" else None)

    def spans(self, strategy: str) -> DataFrame:
        """The chunks of a strategy, without text."""
        return self.table(f"spans-{strategy}", lambda: chunking.chunker(strategy, self.threshold if strategy == "semantic" else None)(self.passages))

    def units(self, strategy: str) -> DataFrame:
        """(chunk_id, passage_id, chunk_index, char_start, char_end, text): a strategy's chunks with their text."""
        if strategy == "passage":
            return self.passages.select(chunking.chunk_id(F.col("passage_id"), F.lit(0)).alias("chunk_id"), "passage_id", F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
        if strategy == "sentence":
            return chunking.sentence_units(self.passages)
        return chunking.chunk_text(self.spans(strategy), self.passages).select("chunk_id", "passage_id", "chunk_index", "char_start", "char_end", "text")

    def lexical(self, strategy: str) -> index.Lexical:
        """Postings by bucket of their term, document frequencies and the two numbers of the whole index. Postings are written where they
        are made, each task its share of every bucket, so they are not shuffled; the units are counted as they pass (exactly, as the
        tasks that write are those that count)."""
        return self._indexed(strategy, "", lambda units, seen: index.counted(units.observe(seen, F.count(F.lit(1)).alias("n"))))

    def _indexed(self, strategy: str, prefix: str, count: Callable[[DataFrame, Observation], DataFrame | None]) -> index.Lexical:
        """The tables of an index. `count` gives the postings of units, which it observes; None if they come from those of `lexical`."""
        units, seen = self.units(strategy), Observation()
        written = []

        def made() -> DataFrame:
            postings = count(units, seen)
            if postings is None:
                return index.dealt(index.stemmed(self.lexical(strategy)).postings)
            written.append(strategy)
            return postings.withColumn("bucket", index.bucket(F.col("term")))

        postings = self.table(f"{prefix}postings-{strategy}", made, ("bucket",))
        df = self.table(f"{prefix}df-{strategy}", lambda: postings.groupBy("term").agg(F.count("*").alias("df")))
        stats = self.table(f"{prefix}stats-{strategy}", lambda: index.numbers(postings, self.n if strategy == "passage" else seen.get["n"] if written else units.count()))
        return index.Lexical(postings, df, stats)

    def stemmed(self, strategy: str) -> index.Lexical:
        """The index of `lexical` by stem, made from the texts as that is: the terms that have another stem go to all tasks. Only where they
        are too many, it is made from the postings of `lexical`, which move twice."""

        def count(units: DataFrame, seen: Observation) -> DataFrame | None:
            stems = index.stem_map(units)
            return None if stems is None else index.counted(units.observe(seen, F.count(F.lit(1)).alias("n")), stems=stems)

        return self._indexed(strategy, "stemmed-", count)

    def stem_counts(self, strategy: str) -> DataFrame:
        """(term, df, cf) of the index by stem, without making it."""
        units = self.units(strategy)
        stems = index.stem_map(units)
        return self.stemmed(strategy).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")) if stems is None else index.stem_counts(units, stems)

    def mentions(self) -> DataFrame:
        return self.table("mentions", lambda: index.mentions(self.passages))

    def entities(self) -> DataFrame:
        return self.table("entities", lambda: index.entities(self.mentions(), self.n))

    def edges(self) -> DataFrame:
        return self.table("edges", lambda: index.graph(self.mentions(), self.entities()))

    def vectors(self, strategy: str, name: str, embed) -> DataFrame:
        """(chunk_id, passage_id, embedding) by the model `name`."""
        return self.table(f"vectors-{strategy}-{name}", lambda: self.units(strategy).select("chunk_id", "passage_id", embed(F.col("text")).alias("embedding")))

