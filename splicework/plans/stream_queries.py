"""Streams over the events: read as they arrive, windowed, and written to the shared folder; what a query returns is read there.

Each stream takes the events in files as they are, in one or more batches, and ends when it has taken all. Windows and
sessions that the watermark has not passed by then are still open and not part of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicework.operators.tables import shared_folder
from splicework.plans.queries import query
from splicework.streaming import power

LATE_S = 3600


def _events(spark, sf_dir) -> DataFrame:
    e = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern may name a file, a path only a folder
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")  # whatever the session's time zone
    return e.select(F.col("user_id").alias("track"), F.col("event_id"), F.timestamp_micros(micros).alias("ts"), F.col("value"))


def _taken(stream: DataFrame, mode: str = "append", write=None) -> DataFrame:
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out = f"{shared_folder(spark)}/splicework/{spark.sparkContext.applicationId}/stream-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    (writer.foreachBatch(write(out)) if write else writer.format("parquet").option("path", out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if not write else spark.read.parquet(out).drop("batch")


_EV = f"ev AS (SELECT user_id AS track, event_id, ts, value, epoch_us(ts) // 1000 AS ms FROM events), wm AS (SELECT (max(ms) - {LATE_S * 1000}) AS wm FROM ev)"


@query(f"""WITH {_EV}, w AS (SELECT track, ms // 7200000 * 7200000 AS a, count(*) AS n, round(sum(value * value), 4) AS power FROM ev GROUP BY ALL) SELECT track, a, n, power FROM w, wm WHERE a + 7200000 <= wm""")
def stream_tumbling(spark, sf_dir):
    """Power in windows of two hours."""
    own = _taken(power.tumbling_power(_events(spark, sf_dir), "track", "ts", "value", "2 hours", f"{LATE_S} seconds"))
    return own.select("track", F.unix_millis("start").alias("a"), "n", F.round("power", 4).alias("power"))


@query(f"""WITH {_EV}, w AS (SELECT track, (ms // 1800000 - k) * 1800000 AS a, count(*) AS n, round(sum(value * value), 4) AS power FROM ev, range(4) r(k) GROUP BY ALL) SELECT track, a, n, power FROM w, wm WHERE a + 7200000 <= wm""")
def stream_sliding(spark, sf_dir):
    """Power in windows of two hours, half an hour apart."""
    own = _taken(power.sliding_power(_events(spark, sf_dir), "track", "ts", "value", "2 hours", "30 minutes", f"{LATE_S} seconds"))
    return own.select("track", F.unix_millis("start").alias("a"), "n", F.round("power", 4).alias("power"))


@query(f"""WITH {_EV}, i AS (SELECT track, ms AS a, ms + event_id % 90 * 60000 AS z FROM ev), m AS (SELECT *, max(z + 1800000 - 1) OVER (PARTITION BY track ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT track, min(a) AS a, max(z) AS z, count(*) AS n FROM g GROUP BY track, g)
  SELECT track, a, z, n FROM u, wm WHERE z + 1800000 - 1 <= wm""")
def stream_regions(spark, sf_dir):
    """Regions of intervals less than half an hour apart, each interval with a length of its own."""
    e = _events(spark, sf_dir).withColumn("length", F.col("event_id") % 90 * 60_000)
    own = _taken(power.regions(e, "track", "ts", "length", 1_800_000, f"{LATE_S} seconds"))
    return own.select("track", F.unix_millis("start").alias("a"), F.unix_millis("stop").alias("z"), "n")


@query("SELECT user_id AS track, count(*) AS n, round(sum(value * value), 4) AS power, round(max(abs(value)), 6) AS peak FROM events GROUP BY user_id")
def stream_meter(spark, sf_dir):
    """Rows, power and peak of each track, kept as state from batch to batch; the last of each."""

    def write(out):
        return lambda batch, number: batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    every = _taken(power.metered(_events(spark, sf_dir), "track", "value"), "update", write)
    last = every.groupBy("track").agg(F.max_by(F.struct("n", "power", "peak"), "number").alias("m"))
    return last.select("track", "m.n", F.round("m.power", 4).alias("power"), F.round("m.peak", 6).alias("peak"))


@query("SELECT DISTINCT user_id AS track, event_id % 40 AS request FROM events")
def stream_once(spark, sf_dir):
    """Requests that arrive again and again, each applied once."""
    e = _events(spark, sf_dir).select("track", (F.col("event_id") % 40).alias("request"))
    return _taken(e, "append", lambda out: power.once(out, ["track", "request"]))
