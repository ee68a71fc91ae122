"""Tables in the folder that the cluster shares, between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without it, one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _own[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table there: no round repeats those before it, and a lost executor costs none of them."""
    path = f"{shared_folder(df.sparkSession)}/splicework/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def published(df: DataFrame, path: str) -> DataFrame:
    """df at path, whole or not at all; an error if anything is there. Spark's commit moves the files in place when all are written."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
