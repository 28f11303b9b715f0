"""The shared folder: where it is, tables written there, and commits by rename."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset and everything runs on this machine (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_quillon_folder", None) or "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark._quillon_folder = at
    return at


def commit(spark: SparkSession, attempt: str, at: str) -> bool:
    """Renames the folder or file `attempt` to `at`, which is atomic and never replaces what is there; whether it did."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(at).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(hadoop.Path(attempt), hadoop.Path(at), spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "IOException") and context.util().exists(hadoop.Path(at)):
            return False
        raise
    return True


def written(df: DataFrame, label: str) -> DataFrame:
    """`df`, written to the shared folder and read again: computed once, and its lineage is cut."""
    at = f"{shared_folder(df.sparkSession)}/work/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a frame that `written` gave, which nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/work/" not in folder:
            raise ValueError(f"not written here: {folder}")
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def listed(spark: SparkSession, at: str) -> list[str]:
    """The names in a folder, sorted; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
