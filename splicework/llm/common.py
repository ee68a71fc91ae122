"""Shared helpers: words, folds, running totals and tables kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/splicework/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column of numbered(): a name that tables are not expected to have.
ROW = "_splicework_row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder with a key of each row in ROW; ids may be null or repeat."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 <= fold < n, or -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(n), F.lit(-1)).cast("int")


def running_total(values: Column, size: int = 256, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Inclusive running totals (or merges, from 0) of an array<int>, in chunks, so that long arrays cost n * size and not n * n."""
    empty = F.array().cast("array<int>")
    n_chunks = F.ceil(F.size(values) / F.lit(size)).cast("int")

    def chunk(c: Column) -> Column:
        return F.slice(values, c * F.lit(size) + F.lit(1), F.lit(size))

    def totals(some: Column, start: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(start.alias("t"), empty.alias("a")),
            lambda s, x: F.struct(merge(s["t"], x).alias("t"), F.concat(s["a"], F.array(merge(s["t"], x))).alias("a")),
            lambda s: s["a"],
        )

    chunks = F.sequence(F.lit(0), n_chunks - F.lit(1))
    ends = totals(F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), merge)), F.lit(0))
    starts = F.slice(F.concat(F.array(F.lit(0)), ends), 1, n_chunks)
    many = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), chunks.alias("c")), lambda z: totals(chunk(z["c"]), z["s"])))
    return F.when(F.size(values) == 0, empty).when(F.size(values) <= size, totals(values, F.lit(0))).otherwise(many)
