"""Tables and checkpoints in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; where that is unset and Spark runs in this
process alone, a temporary one is taken; on a cluster that is an error, as other machines wouldn't see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def available(spark: SparkSession) -> bool:
    return bool(spark.sparkContext.getConf().get("spark.checkpoint.dir", None)) or spark.sparkContext.master.split("[")[0] == "local"


def folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not available(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="veilsight-core-"))
    return "file://" + _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/veilsight-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is read again: a cut in the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
