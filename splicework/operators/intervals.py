"""Half-open intervals [start, stop) in integer ticks, within keys such as a track.

Every operator takes DataFrames with columns start and stop beside its keys. Joins on overlap always carry
an equality: intervals are cut into buckets of `width` ticks, and a pair is kept only in the bucket where the
later of its two starts lies, so that it is found once and a hot key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def overlaps(start: Column, stop: Column, other_start: Column, other_stop: Column) -> Column:
    return (start < other_stop) & (other_start < stop)


def buckets(start: Column, stop: Column, width: int) -> Column:
    """The numbers of all buckets that [start, stop) touches."""
    return F.sequence(F.floor(start / width), F.floor((F.greatest(stop, start + 1) - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of equal keys whose intervals overlap; right's start and stop become other_start and other_stop."""
    right = right.withColumnsRenamed({"start": "other_start", "stop": "other_stop"})
    a = left.withColumn("_bucket", F.explode(buckets(F.col("start"), F.col("stop"), width)))
    b = right.withColumn("_bucket", F.explode(buckets(F.col("other_start"), F.col("other_stop"), width)))
    both = a.join(b, [*keys, "_bucket"]).where(overlaps(F.col("start"), F.col("stop"), F.col("other_start"), F.col("other_stop")))
    return both.where(F.floor(F.greatest("start", "other_start") / width) == F.col("_bucket")).drop("_bucket")


def as_of(points: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """points (keys, at, ...) with the value of the last change at or before at; one pass over their union."""
    p = points.withColumns({"_value": F.lit(None).cast(changes.schema[value].dataType), "_point": F.lit(1)})
    c = changes.select(*keys, F.col("at"), F.col(value).alias("_value"), F.lit(0).alias("_point"))
    last = F.last("_value", ignorenulls=True).over(_by(keys, "at", "_point").rowsBetween(W.Window.unboundedPreceding, 0))
    return p.unionByName(c, allowMissingColumns=True).withColumn(value, last).where("_point = 1").drop("_value", "_point")


def merged(rows: DataFrame, keys: list[str], bridge: int = 0) -> DataFrame:
    """Unions of intervals that overlap, touch, or (bridge > 0) lie less than bridge apart: keys, start, stop, members."""
    reach = F.max("stop").over(_by(keys, "start", "stop").rowsBetween(W.Window.unboundedPreceding, -1))
    apart = F.col("start") - reach
    new = reach.isNull() | ((apart >= bridge) if bridge else (apart > 0))
    group = F.sum("_new").over(_by(keys, "start", "stop").rowsBetween(W.Window.unboundedPreceding, 0))
    grouped = rows.withColumn("_new", new.cast("int")).withColumn("_group", group).groupBy(*keys, "_group")
    return grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("members")).drop("_group")


def holes(rows: DataFrame, keys: list[str], start: Column, stop: Column) -> DataFrame:
    """What of [start, stop) no interval of a key covers."""
    own = merged(rows.where((F.col("stop") > start) & (F.col("start") < stop)), keys)
    before = F.coalesce(F.lag("stop").over(_by(keys, "start")), start)
    inner = own.select(*keys, before.alias("a"), F.col("start").alias("b"))
    tail = own.groupBy(*keys).agg(F.max("stop").alias("a")).select(*keys, "a", stop.alias("b"))
    return inner.unionByName(tail).where("a < b").select(*keys, F.col("a").alias("start"), F.col("b").alias("stop"))


def sliced(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """The parts of clips within [start, stop), their source offsets moved along."""
    a = F.greatest("start", start)
    inside = rows.where(overlaps(F.col("start"), F.col("stop"), start, stop))
    return inside.withColumns({"source_in": F.col("source_in") + a - F.col("start"), "start": a, "stop": F.least("stop", stop)})


def subtracted(clips: DataFrame, cuts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The pieces of clips that cuts leave, with their source offsets; clips have a column id."""
    cuts = merged(cuts.select(*keys, "start", "stop"), keys).drop("members")
    names = [*keys, "id", "start", "stop", "source_in"]
    hit = overlap_join(clips.select(*names), cuts, keys, width)
    # a row for the clip itself stands before its cuts: what is left before each cut, and behind the last, in one pass
    rows = clips.select(*names).withColumns({c: F.lit(None).cast("long") for c in ("other_start", "other_stop")}).unionByName(hit.select(*names, "other_start", "other_stop"))
    order = W.Window.partitionBy(*keys, "id", "start").orderBy(F.col("other_start").asc_nulls_first())
    before = F.struct(F.coalesce(F.lag("other_stop").over(order), F.col("start")).alias("a"), F.col("other_start").alias("b"))
    behind = F.when(F.lead(F.lit(1)).over(order).isNull(), F.struct(F.coalesce("other_stop", "start").alias("a"), F.col("stop").alias("b")))
    rows = rows.withColumns({"_before": before, "_behind": behind})
    pieces = rows.select(*keys, "id", F.col("start").alias("s"), "source_in", F.explode(F.array("_before", "_behind")).alias("p")).where("p.a < p.b")
    return pieces.select(*keys, "id", F.col("p.a").alias("start"), F.col("p.b").alias("stop"), (F.col("source_in") + F.col("p.a") - F.col("s")).alias("source_in"))


def rippled(clips: DataFrame, cuts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Ripple delete: the pieces, moved left by what was cut before them."""
    gone = merged(cuts.select(*keys, "start", "stop"), keys).select(*keys, F.col("stop").alias("at"), (F.col("stop") - F.col("start")).alias("n"))
    total = gone.withColumn("removed", F.sum("n").over(_by(keys, "at").rowsBetween(W.Window.unboundedPreceding, 0)))
    pieces = subtracted(clips, cuts, keys, width).withColumn("at", F.col("start"))
    shift = F.coalesce("removed", F.lit(0))
    return as_of(pieces, total, keys, "removed").withColumns({"start": F.col("start") - shift, "stop": F.col("stop") - shift}).drop("at", "removed")


def split_at(clips: DataFrame, at: Column) -> DataFrame:
    """Each clip that crosses at becomes two; part is 0 or 1."""
    crosses = (F.col("start") < at) & (at < F.col("stop"))
    left = F.struct(F.col("start").alias("start"), at.alias("stop"), F.col("source_in").alias("source_in"), F.lit(0).alias("part"))
    right = F.struct(at.alias("start"), F.col("stop").alias("stop"), (F.col("source_in") + at - F.col("start")).alias("source_in"), F.lit(1).alias("part"))
    same = F.struct(F.col("start").alias("start"), F.col("stop").alias("stop"), F.col("source_in").alias("source_in"), F.lit(0).alias("part"))
    rest = [c for c in clips.columns if c not in ("start", "stop", "source_in")]
    return clips.select(*rest, F.explode(F.when(crosses, F.array(left, right)).otherwise(F.array(same))).alias("_p")).select(*rest, "_p.*")


def inserted(clips: DataFrame, at: Column, length: int) -> DataFrame:
    """Room of length ticks at a time: crossing clips are split, what is at or behind it moves right."""
    move = F.when(F.col("start") >= at, length).otherwise(0)
    return split_at(clips, at).withColumns({"start": F.col("start") + move, "stop": F.col("stop") + move})


def placed(rows: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Sequential clips with the start and stop that the running sum of their lengths gives."""
    stop = F.sum(length).over(_by(keys, order).rowsBetween(W.Window.unboundedPreceding, 0))
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(length))


def rolled(clips: DataFrame, keys: list[str], left_id: Column, shift: int) -> DataFrame:
    """Moves the cut between the clip left_id and the one that begins where it ends."""
    order = _by(keys, "start")
    next_touches = F.lead("start").over(order) == F.col("stop")
    is_left = (F.col("id") == left_id) & next_touches
    is_right = (F.lag("id").over(order) == left_id) & (F.lag("stop").over(order) == F.col("start"))
    own = clips.withColumns({"_l": F.coalesce(is_left, F.lit(False)), "_r": F.coalesce(is_right, F.lit(False))})
    move = lambda flag: F.when(F.col(flag), shift).otherwise(0)
    return own.withColumns({"stop": F.col("stop") + move("_l"), "start": F.col("start") + move("_r"), "source_in": F.col("source_in") + move("_r")}).drop("_l", "_r")


def most_at_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest number of intervals that hold at once; at the same instant, ends come before starts."""
    events = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.*")
    depth = F.sum("d").over(_by(keys, "at", "d").rowsBetween(W.Window.unboundedPreceding, 0))
    return events.withColumn("depth", depth).groupBy(*keys).agg(F.max("depth").alias("most"))


def segments(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Elementary intervals between all boundaries of a key, with the number of intervals that hold in each."""
    edges = rows.select(*keys, F.explode(F.array("start", "stop")).alias("start")).distinct()
    cells = edges.withColumn("stop", F.lead("start").over(_by(keys, "start"))).where("stop is not null")
    held = overlap_join(cells, rows.select(*keys, "start", "stop"), keys, width)
    return held.groupBy(*keys, "start", "stop").agg(F.count("*").alias("layers"))


def visible(points: DataFrame, clips: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The topmost clip (greatest layer, then least id) at each point (keys, at)."""
    p = points.withColumns({"start": F.col("at"), "stop": F.col("at") + 1})
    hit = overlap_join(p, clips.select(*keys, "start", "stop", "layer", "id"), keys, width)
    return hit.groupBy(*keys, "at").agg(F.max_by("id", F.struct("layer", -F.col("id"))).alias("id"))


def collisions(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of different clips of a key that overlap, the lesser id first: keys, id, other_id."""
    other = rows.select(*keys, F.col("id").alias("other_id"), "start", "stop")
    return overlap_join(rows.select(*keys, "id", "start", "stop"), other, keys, width).where("id < other_id").select(*keys, "id", "other_id")


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Each mark's nearest point within reach ticks, the earlier on ties: keys, mark, at."""
    m = marks.select(*keys, F.col("mark"), (F.col("mark") - reach).alias("start"), (F.col("mark") + reach + 1).alias("stop"))
    p = points.select(*keys, F.col("at"), F.col("at").alias("start"), (F.col("at") + 1).alias("stop"))
    hit = overlap_join(m, p, keys, 2 * reach + 1)
    return hit.groupBy(*keys, "mark").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("mark")), F.col("at"))).alias("at"))
