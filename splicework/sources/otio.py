"""OpenTimelineIO documents, the public JSON format: timelines to clip rows, and back. A row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

TIME = "STRUCT<OTIO_SCHEMA: STRING, value: DOUBLE, rate: DOUBLE>"
RANGE = f"STRUCT<OTIO_SCHEMA: STRING, start_time: {TIME}, duration: {TIME}>"
MEDIA = "STRUCT<OTIO_SCHEMA: STRING, target_url: STRING>"
ITEM = f"STRUCT<OTIO_SCHEMA: STRING, name: STRING, source_range: {RANGE}, media_reference: {MEDIA}, media_references: MAP<STRING, {MEDIA}>, active_media_reference_key: STRING>"
TRACK = f"STRUCT<OTIO_SCHEMA: STRING, name: STRING, kind: STRING, children: ARRAY<{ITEM}>>"
DOCUMENT = f"OTIO_SCHEMA STRING, name STRING, tracks STRUCT<OTIO_SCHEMA: STRING, children: ARRAY<{TRACK}>>"


def _ticks(time: Column, rate: int) -> Column:
    """A time at our rate; null where it does not fall on a tick."""
    n = time["value"] * rate / time["rate"]
    return F.when(n == F.floor(n), n.cast("long"))


def items(documents: DataFrame, id_col: str, json_col: str, rate: int) -> DataFrame:
    """What the tracks of each document hold: id, track (from 0), kind, ordinal, type (Clip, Gap, ...), name, source_in, length, url.

    A document that is no Timeline, or no JSON, has none."""
    own = documents.select(id_col, F.from_json(json_col, DOCUMENT).alias("_d")).where(F.col("_d.OTIO_SCHEMA").startswith("Timeline."))
    own = own.select(id_col, F.posexplode("_d.tracks.children").alias("track", "_t"))
    own = own.select(id_col, "track", F.col("_t.kind").alias("kind"), F.posexplode("_t.children").alias("ordinal", "_i"))
    i = F.col("_i")
    media = F.coalesce(F.element_at(i["media_references"], F.coalesce(i["active_media_reference_key"], F.lit("DEFAULT_MEDIA"))), i["media_reference"])
    return own.select(
        id_col, "track", "kind", "ordinal", F.substring_index(i["OTIO_SCHEMA"], ".", 1).alias("type"), i["name"].alias("name"),
        _ticks(i["source_range"]["start_time"], rate).alias("source_in"), _ticks(i["source_range"]["duration"], rate).alias("length"), media["target_url"].alias("url"),
    )


def imported(documents: DataFrame, id_col: str, json_col: str, rate: int) -> DataFrame:
    """Clips with their places: id, track, kind, ordinal, name, url, source_in, start, stop; gaps only take room."""
    w = W.Window.partitionBy(id_col, "track").orderBy("ordinal").rowsBetween(W.Window.unboundedPreceding, 0)
    own = items(documents, id_col, json_col, rate).where(F.col("type").isin("Clip", "Gap"))
    stop = F.sum("length").over(w)
    own = own.withColumns({"start": stop - F.col("length"), "stop": stop})
    return own.where("type = 'Clip'").select(id_col, "track", "kind", "ordinal", "name", "url", "source_in", "start", "stop")


def losses(documents: DataFrame, id_col: str, json_col: str, rate: int) -> DataFrame:
    """What an import would lose: id, track, ordinal, loss (its type, or time: not on our clock, or unknown)."""
    own = items(documents, id_col, json_col, rate)
    plain = F.col("type").isin("Clip", "Gap")
    lost = F.when(~plain, F.col("type")).when(F.col("length").isNull() | F.col("source_in").isNull(), "time")
    return own.select(id_col, "track", "ordinal", lost.alias("loss")).where("loss is not null")


def exported(clips: DataFrame, keys: list[str], track: str, rate: int) -> DataFrame:
    """A row per key with its clips (track, kind, name, url, source_in, start, stop) as a document; gaps fill what is empty.

    Clips of a track must not overlap; tracks come in order of track."""
    w = W.Window.partitionBy(*keys, track).orderBy("start", "stop")
    time = lambda v: F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), v.cast("double").alias("value"), F.lit(float(rate)).alias("rate"))
    span = lambda a, n: F.struct(F.lit("TimeRange.1").alias("OTIO_SCHEMA"), time(a).alias("start_time"), time(n).alias("duration"))
    media = lambda r: F.struct(F.lit("ExternalReference.1").alias("OTIO_SCHEMA"), r["url"].alias("target_url"))
    no_media = F.lit(None).cast(MEDIA)
    clip = lambda r: F.struct(F.lit("Clip.1").alias("OTIO_SCHEMA"), r["name"].alias("name"), span(r["source_in"], r["stop"] - r["start"]).alias("source_range"), media(r).alias("media_reference"))
    gap_length = F.col("start") - F.coalesce(F.lag("stop").over(w), F.lit(0))
    own = clips.withColumn("_gap", gap_length)
    gap = lambda r: F.struct(F.lit("Gap.1").alias("OTIO_SCHEMA"), F.lit("").alias("name"), span(F.lit(0), r["_gap"]).alias("source_range"), no_media.alias("media_reference"))
    items_of = lambda r: F.when(r["_gap"] > 0, F.array(gap(r), clip(r))).otherwise(F.array(clip(r)))
    # rows are sorted and gathered as narrow as they are; items are made of what was gathered
    own = own.select(*keys, track, "kind", F.struct("start", "stop", "_gap", "name", "source_in", "url").alias("_row"))
    lanes = own.groupBy(*keys, track, "kind").agg(F.flatten(F.transform(F.sort_array(F.collect_list("_row")), items_of)).alias("children"))
    lane = F.struct(F.lit("Track.1").alias("OTIO_SCHEMA"), F.col(track).cast("string").alias("name"), "kind", "children")
    every = lanes.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(track, lane.alias("_lane")))), lambda r: r["_lane"]).alias("_lanes"))
    stack = F.struct(F.lit("Stack.1").alias("OTIO_SCHEMA"), F.col("_lanes").alias("children"))
    document = F.struct(F.lit("Timeline.1").alias("OTIO_SCHEMA"), F.concat_ws("/", *keys).alias("name"), stack.alias("tracks"))
    return every.select(*keys, F.to_json(document).alias("otio"))
