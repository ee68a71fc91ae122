"""Structured Streaming forms of windows, sessions, running state and exactly-once writes over a stream of (key, ts, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_power(stream: DataFrame, key: str, ts: str, value: str, window: str, late: str) -> DataFrame:
    """Power per key and fixed window; rows later than the watermark are left out."""
    return sliding_power(stream, key, ts, value, window, window, late)


def sliding_power(stream: DataFrame, key: str, ts: str, value: str, window: str, slide: str, late: str) -> DataFrame:
    """Power per key and window; a row counts in each of the windows it lies in, window / slide of them."""
    own = stream.withWatermark(ts, late).groupBy(F.col(key), F.window(ts, window, slide).alias("w"))
    return own.agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("power")).select(key, F.col("w.start").alias("start"), "n", "power")


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's rows with less than gap between neighbours."""
    own = stream.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
    return own.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def regions(stream: DataFrame, key: str, ts: str, length_ms: str, bridge_ms: int, late: str) -> DataFrame:
    """Regions of a key's intervals [ts, ts + length_ms) that lie less than bridge_ms apart, from the end of one to the start of the next.

    Spark's sessions join at equality, where two regions stay apart here; so each row's gap is its length and the bridge,
    less a millisecond, and times are taken to the millisecond, as whole ones alone can be told apart so. stop is the last end."""
    gap = F.concat((F.col(length_ms) + (bridge_ms - 1)).cast("string"), F.lit(" milliseconds"))
    stop = F.timestamp_millis(F.unix_millis(ts) + F.col(length_ms))
    own = stream.withColumn(ts, F.timestamp_millis(F.unix_millis(ts))).withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
    return own.agg(F.max(stop).alias("stop"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "stop", "n")


def metered(stream: DataFrame, key: str, value: str) -> DataFrame:
    """After each batch, for each key that had rows: all rows so far, their power and their peak. The state of a key is three numbers."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, power, peak = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            v = f[value].astype(float)
            n, power, peak = n + len(v), power + float((v * v).sum()), max(peak, float(v.abs().max()))
        state.update((n, power, peak))
        yield pd.DataFrame({key: [k[0]], "n": [n], "power": [power], "peak": [peak]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, power double, peak double", "n long, power double, peak double", "update", GroupStateTimeout.NoTimeout)


def once(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each request (keys) is written once, under its batch's number.

    A batch that is run again after a failure overwrites what it had written, and rows that an earlier batch wrote are left
    out; so each request is applied exactly once, whatever is sent or run again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema
        try:
            before = spark.read.schema(kind).option("basePath", folder).parquet(f"{folder}/batch=*").select(*keys, "batch").where(F.col("batch") < number)
            rows = batch.dropDuplicates(keys).join(before.select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = batch.dropDuplicates(keys)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
