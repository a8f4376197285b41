"""Tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that is
unset and Spark runs in this process alone (a local master), a temporary folder is named
instead; on a cluster that is an error, as other machines wouldn't see such a folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="veilsight-"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_own[0])
    return "file://" + _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/veilsight-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` and reads it again: a cut in the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veilsight_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what ``table`` wrote; ``df`` must not be used any more."""
    path = getattr(df, "_veilsight_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
