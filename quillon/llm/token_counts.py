"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never recounted: each batch of signed changes (documents inserted,
deleted, or counted anew) is added up into a small delta, which is committed once under the batch's id, so a batch may be
sent any number of times. Totals are the last snapshot and the deltas since; `compact` adds them up into the next one.

*Commits.* Every attempt at a batch writes its delta to a folder of its own and then renames the folder to the batch's name,
which fails where that exists. The rename is the commit: what was not renamed is never read, a committed delta is never
written again, and of two runners of one batch one wins. This asks of the shared folder that a rename of a folder is atomic
(HDFS, POSIX). Snapshots commit in the same way, under the number of batches that they hold.

Changes have the columns source, lang, tokenizer_version (null is a value of its own), docs (+1, -1 or 0) and tokens
(signed). Null counts add nothing. Changes are added up as they come: rows repeated with one doc_id count each, and a
document deleted but never inserted makes negative totals, which show as such until its insertion arrives. Null and empty
texts have no tokens and count as documents; very long texts are counted whole, in their task. An empty batch is committed
like any other, and an empty table gives empty totals. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, shared_dir, stored, text_or_empty

BY = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, docs long, tokens long"
MAIL = r"[^\x20\x09-\x0D]+@[^\x20\x09-\x0D]+"
#: Native tokenizers by version: words between white space; runs of letters, single digits and single signs.
TOKENIZERS = {"words-1": WORD, "pieces-1": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]"}


def inserted(tokens: Column) -> dict[str, Column]:
    return {"docs": F.lit(1), "tokens": tokens}


def deleted(tokens: Column) -> dict[str, Column]:
    return {"docs": F.lit(-1), "tokens": -tokens}


def revised(before: Column, after: Column) -> dict[str, Column]:
    return {"docs": F.lit(0), "tokens": after - before}


class Rollup:
    """A rollup in the folder `path`, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _commit(self, attempt: str, name: str) -> bool:
        """Rename the folder `attempt` to `name`; False if that exists."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdir(self._path(name).getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        try:
            fs.rename(self._path(attempt), self._path(name), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError:
            if name.rpartition("/")[2] not in self._names(name.rpartition("/")[0]):
                raise
            fs.delete(self._path(attempt), True)
            return False

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        return self._names("deltas")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"not a batch id: {batch}")
        if batch in self.committed():
            return False
        delta = changes.groupBy(*[F.col(c).cast("string").alias(c) for c in BY]).agg(F.sum(F.coalesce(F.col("docs"), F.lit(0)).cast("long")).alias("docs"), F.sum(F.coalesce(F.col("tokens"), F.lit(0)).cast("long")).alias("tokens"))
        attempt = f"attempts/{batch}-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/{attempt}")
        return self._commit(attempt, f"deltas/{batch}")

    def _state(self) -> tuple[DataFrame, list[str]]:
        """Sums of the last snapshot and of the deltas since, not yet added up, and all batches in them."""
        batches = self.committed()
        deltas, held = self.spark.createDataFrame([], DELTA), set()
        if last := self._names("snapshots")[-1:]:
            held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{last[0]}/batches").collect()}
            deltas = self.spark.read.schema(DELTA).parquet(f"{self.path}/snapshots/{last[0]}/totals")
        if new := [f"{self.path}/deltas/{b}" for b in batches if b not in held]:
            deltas = deltas.unionByName(self.spark.read.schema(DELTA).parquet(*new))
        return deltas.groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), batches

    def compact(self) -> bool:
        """Commit a snapshot of all batches so far, from which `totals` go on; False if there is one of as many."""
        sums, batches = self._state()
        name, attempt = f"snapshots/{len(batches):012d}", f"attempts/snapshot-{uuid.uuid4().hex}"
        if name.rpartition("/")[2] in self._names("snapshots"):
            return False
        sums.write.parquet(f"{self.path}/{attempt}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.parquet(f"{self.path}/{attempt}/batches")
        return self._commit(attempt, name)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, docs, tokens) over all committed batches; groups without documents and tokens left out."""
        return self._state()[0].where("docs <> 0 or tokens <> 0")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, before, after): token counts as loaded, and without mail addresses."""
    text = text_or_empty()
    plain = F.regexp_replace(text, MAIL, "")
    per = [F.struct(F.lit(v).alias("tokenizer_version"), F.regexp_count(text, F.lit(r)).cast("long").alias("before"), F.regexp_count(plain, F.lit(r)).cast("long").alias("after")) for v, r in TOKENIZERS.items()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.explode(F.array(*per)).alias("c"))
    return rows.select("doc_id", "source", "lang", "c.*")


def corpus_rollup(docs: DataFrame, labels: DataFrame, path: str | None = None) -> Rollup:
    """Three batches over all documents: loaded; counted anew once mail addresses are gone; those labelled of quality 0
    retired. The first two are sent twice, and a snapshot is taken before the last."""
    spark = docs.sparkSession
    rows = stored(counted(docs), "token-counts")
    rollup = Rollup(spark, path or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    load = rows.withColumns(inserted(F.col("before")))
    revise = rows.where("before <> after").withColumns(revised(F.col("before"), F.col("after")))
    bad = labels.where("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    retire = rows.join(bad, "doc_id", "left_semi").withColumns(deleted(F.col("after")))
    for batch, changes in (("load", load), ("revise", revise), ("load", load), ("retire", retire), ("revise", revise)):
        if batch == "retire":
            rollup.compact()
        rollup.commit(batch, changes)
    return rollup


SQL = r"""
with texts as (
  select doc_id, source, lang, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+@[^\x20\x09-\x0D]+', '', 'g') as u,
         doc_id in (select doc_id from labels where quality = 0 and doc_id is not null) as gone
  from documents
), counts as (
  select source, lang, 'words-1' as tokenizer_version, gone, len(regexp_extract_all(u, '[^\x20\x09-\x0D]+')) as n from texts
  union all
  select source, lang, 'pieces-1', gone, len(regexp_extract_all(u, '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]')) from texts
)
select source, lang, tokenizer_version, count(*) filter (not coalesce(gone, false))::bigint as docs,
       coalesce(sum(n) filter (not coalesce(gone, false)), 0)::bigint as tokens
from counts group by all having docs <> 0 or tokens <> 0
"""
