"""Clocks: speed maps, frame holds, frame mapping, camera angles, and linked clips out of step.

Times are integer ticks; positions that need not be whole are exact fractions num / den.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators import intervals as iv


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def speed_spans(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """segments (keys, order, length, rate_a, rate_b in thousandths, reverse) with start, stop (output ticks) and origin.

    Over a segment the rate goes evenly from rate_a to rate_b; origin is the source position where it begins, from 0 on,
    in 2000ths of a tick. Lengths are positive."""
    own = iv.placed(segments, keys, order, "length")
    way = F.col("length") * (F.col("rate_a") + F.col("rate_b")) * F.when(F.col("reverse"), -1).otherwise(1)
    return own.withColumn("origin", F.sum(way).over(_by(keys, order).rowsBetween(W.Window.unboundedPreceding, 0)) - way)


def source_times(points: DataFrame, segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """points (keys, at, ...) with the exact source position num / den that a speed map gives them.

    At a boundary the later segment counts, at the map's end the last one; before 0 and beyond the end there is none."""
    span = F.struct("start", "stop", "origin", "length", "rate_a", "rate_b", "reverse")
    own = iv.as_of(points, speed_spans(segments, keys, order).select(*keys, F.col("start").alias("at"), span.alias("_span")), keys, "_span")
    s, wide = (lambda n: F.col(f"_span.{n}")), (lambda c: c.cast("decimal(18,0)"))
    t, n = F.col("at") - s("start"), s("length")
    # the integral of the rate over t ticks, times 2000 * length
    way = wide(s("rate_a")) * wide(n * t * 2 - t * t) + wide(s("rate_b")) * wide(t * t)
    num = wide(s("origin")) * wide(n) + F.when(s("reverse"), -way).otherwise(way)
    held = F.col("at") <= s("stop")
    return own.withColumns({"num": F.when(held, num.cast("decimal(38,0)").cast("long")), "den": F.when(held, n * 2000)}).drop("_span")


def held_frames(points: DataFrame, holds: DataFrame, keys: list[str], order: str, end: str) -> DataFrame:
    """points (keys, at from 0 on, ...) with the frame (its order) that an animation shows then.

    Frames (keys, order, hold) show for hold ticks each; behind the last one end is loop, hold, or transparent (null)."""
    own = iv.placed(holds, keys, order, "hold")
    total = own.groupBy(*keys).agg(F.max("stop").alias("_total"))
    at = {"loop": F.col("at") % F.col("_total"), "hold": F.col("at"), "transparent": F.when(F.col("at") < F.col("_total"), F.col("at"))}[end]
    asked = points.join(total, keys).withColumn("_asked", F.col("at")).withColumn("at", at)
    frames = own.select(*keys, F.col("start").alias("at"), F.col(order).alias("frame"))
    return iv.as_of(asked, frames, keys, "frame").withColumn("at", F.col("_asked")).drop("_asked", "_total")


def conformed(frames: DataFrame, keys: list[str], pts: str, rate_num: int, rate_den: int, per_second: int) -> DataFrame:
    """Output frames k from 0 on at rate_num / rate_den a second, to a source's last pts (per_second ticks): keys, k, pts.

    Each shows the latest source frame that is at most half a tick behind its time; frames before the first show none."""
    last = frames.groupBy(*keys).agg(F.max(pts).alias("_last"))
    top = F.floor(F.col("_last") * rate_num / (rate_den * per_second)).cast("long")
    wanted = last.where("_last >= 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), top)))
    at = F.floor((F.col("k") * (2 * rate_den * per_second) + rate_num) / (2 * rate_num)).cast("long")
    asked = wanted.select(*keys, "k", at.alias("at"))
    shown = frames.select(*keys, F.col(pts).alias("at"), F.col(pts).alias("pts"))
    return iv.as_of(asked, shown, keys, "pts").select(*keys, "k", "pts")


def angle_cuts(cuts: DataFrame, angles: DataFrame, keys: list[str], stop: str) -> DataFrame:
    """Camera cuts (keys, at, angle, and the group's end in the column `stop`) as clips: keys, angle, start, stop, source_in.

    A cut lasts until the next. Angles are (keys, angle, angle_start, angle_stop, angle_in); source_in is null where the
    angle does not cover the whole cut, or is unknown."""
    until = F.coalesce(F.lead("at").over(_by(keys, "at")), F.col(stop))
    own = cuts.select(*keys, "angle", F.col("at").alias("start"), until.alias("stop")).where("start < stop")
    covers = (F.col("angle_start") <= F.col("start")) & (F.col("stop") <= F.col("angle_stop"))
    both = own.join(angles, [*keys, "angle"], "left")
    return both.select(*keys, "angle", "start", "stop", F.when(covers, F.col("angle_in") + F.col("start") - F.col("angle_start")).alias("source_in"))


def out_of_sync(pictures: DataFrame, sounds: DataFrame, links: DataFrame, keys: list[str], source: str, width: int) -> DataFrame:
    """Pictures and sounds of one source that play at the same time, but not its same part, and that no link ties:
    keys, source, picture, sound, late (which one lags), off (ticks). links are pairs (picture, sound)."""
    same = [*keys, source]
    a = pictures.select(*same, F.col("id").alias("picture"), "start", "stop", (F.col("start") - F.col("source_in")).alias("_a"))
    b = sounds.select(*same, F.col("id").alias("sound"), "start", "stop", (F.col("start") - F.col("source_in")).alias("_b"))
    hit = iv.overlap_join(a, b, same, width).where("_a <> _b").join(links.select("picture", "sound").distinct(), ["picture", "sound"], "left_anti")
    return hit.select(*same, "picture", "sound", F.when(F.col("_b") > F.col("_a"), "sound").otherwise("picture").alias("late"), F.abs(F.col("_a") - F.col("_b")).alias("off"))


def with_partners(clips: DataFrame, chosen: Column, link: str) -> DataFrame:
    """The chosen clips and all that share a link with one of them; clips without a link (null) stand alone."""
    own = clips.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    tied = own.where(F.col("_chosen") & F.col(link).isNotNull()).select(link).distinct()
    partners = own.where(~F.col("_chosen")).join(tied, link, "left_semi")
    return own.where("_chosen").unionByName(partners).drop("_chosen")


def windows_of(clips: DataFrame, keys: list[str], step: int, most: int) -> DataFrame:
    """Stretches of whole steps, each as long as at most `most` clips allow, that cover a key's clips: keys, start, stop, clips.

    A stretch begins where the one before ends, so a key's clips are folded in order. Where one step alone holds more, the
    stretch is that step, and its clips tell so: one key's crowd does not end the work on all others."""
    shape = clips.where("start < stop").select(*keys, "start", "stop")
    out = f"{', '.join(f'{k} {shape.schema[k].dataType.simpleString()}' for k in keys)}, start long, stop long, clips long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, end = sorted(zip(pdf["start"].tolist(), pdf["stop"].tolist(), strict=True)), int(pdf["stop"].max())
        made, at, begun, running = [], rows[0][0], 0, []
        while at < end:
            first_out = begun + most - len(running)  # the first clip that no longer fits
            room = (rows[first_out][0] - at) // step if begun <= first_out < len(rows) else 0  # steps
            to = end if first_out >= len(rows) else min(end, at + max(room, 1) * step)
            new = begun
            while new < len(rows) and rows[new][0] < to:
                new += 1
            made.append({"start": at, "stop": to, "clips": len(running) + new - begun})
            running = [e for e in running + [e for _, e in rows[begun:new]] if e > to]
            at, begun = to, new
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **m} for m in made])

    return shape.groupBy(*keys).applyInPandas(fold, out)
