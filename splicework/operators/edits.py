"""Edits of placed clips, and what follows from them: cut lists, curves, pauses and lint.

Clips have columns id, start, stop and source_in beside their keys, as in intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators import intervals as iv
from splicework.operators.tables import written


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def slipped(clips: DataFrame, which: Column, shift: int) -> DataFrame:
    """Chosen clips show their source from shift ticks later, in the same place; before the source's start is an error."""
    moved = F.when(which, F.col("source_in") + shift).otherwise(F.col("source_in"))
    return clips.withColumn("source_in", F.when(moved < 0, F.raise_error(F.lit("a slip before the start of its source")).cast("long")).otherwise(moved))


def slid(clips: DataFrame, keys: list[str], middle_id: Column, shift: int) -> DataFrame:
    """Moves a clip between two that touch it, which lengthen and shorten in return; clips without both stay."""
    w = _by(keys, "start", "stop")
    touched = (F.lag("stop").over(w) == F.col("start")) & (F.lead("start").over(w) == F.col("stop"))
    own = clips.withColumn("_mid", F.coalesce((F.col("id") == middle_id) & touched, F.lit(False)))
    own = own.withColumns({"_left": F.coalesce(F.lead("_mid").over(w), F.lit(False)), "_right": F.coalesce(F.lag("_mid").over(w), F.lit(False))})
    move = lambda flag: F.when(flag, shift).otherwise(0)
    start, stop = move(F.col("_mid") | F.col("_right")), move(F.col("_left") | F.col("_mid"))
    return own.withColumns({"start": F.col("start") + start, "stop": F.col("stop") + stop, "source_in": F.col("source_in") + move(F.col("_right"))}).drop("_mid", "_left", "_right")


def overwritten(clips: DataFrame, new: DataFrame, keys: list[str], width: int) -> DataFrame:
    """new clips, and what they leave of clips, in place."""
    kept = iv.subtracted(clips, new, keys, width)
    return kept.unionByName(new.select(*kept.columns))


def placed_over(clips: DataFrame, new: DataFrame, keys: list[str], width: int) -> DataFrame:
    """new clips, and of clips those that overlap none of them: placing that replaces on collision."""
    victims = iv.overlap_join(clips.select(*keys, "id", "start", "stop"), new.select(*keys, "start", "stop"), keys, width)
    return clips.join(victims.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").unionByName(new.select(*clips.columns))


def moved(rows: DataFrame, keys: list[str], order: str, which: Column, to: int) -> DataFrame:
    """The chosen row of each key goes to place `to` (from 1), at most the last; a column place numbers all rows from 1."""
    w = _by(keys, order)
    own = rows.withColumn("_is", which).withColumn("_r", F.row_number().over(w))
    all_rows = W.Window.partitionBy(*keys)
    own = own.withColumns({"_at": F.max(F.when(F.col("_is"), F.col("_r"))).over(all_rows), "_n": F.count("*").over(all_rows)})
    goal = F.least(F.lit(to), F.col("_n"))
    rest = F.col("_r") - (F.col("_r") > F.col("_at")).cast("int")
    place = F.when(F.col("_at").isNull(), F.col("_r")).when(F.col("_is"), goal).otherwise(rest + (rest >= goal).cast("int"))
    return own.withColumn("place", place.cast("long")).drop("_is", "_r", "_at", "_n")


def continuous(clips: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Runs of clips that touch and play one source on without a jump: keys, start, stop, members."""
    w = _by(keys, "start", "stop")
    offset = F.col("source_in") - F.col("start")
    same = (F.lag("stop").over(w) == F.col("start")) & F.lag(source).over(w).eqNullSafe(F.col(source)) & (F.lag(offset).over(w) == offset)
    own = clips.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    # a run's last row knows its first, so that no table of all runs is held
    up_to = w.rowsBetween(W.Window.unboundedPreceding, 0)
    own = own.withColumns({"_at": F.row_number().over(w), "_last": F.coalesce(F.lead("_new").over(w), F.lit(1)) == 1})
    own = own.withColumn("_first", F.last(F.when(F.col("_new") == 1, F.struct("_at", "start")), ignorenulls=True).over(up_to)).where("_last")
    members = (F.col("_at") - F.col("_first")["_at"] + 1).cast("long")
    stop = F.when(members > 1, F.greatest("start", "stop")).otherwise(F.col("stop"))
    return own.select(*keys, F.col("_first")["start"].alias("start"), stop.alias("stop"), members.alias("members"))


def cut_list(clips: DataFrame, keys: list[str], source: str, width: int) -> DataFrame:
    """Times within a key's range where the visible clip changes: keys, at, before, after, continuous (as in continuous())."""
    ends = clips.groupBy(*keys).agg(F.min("start").alias("_first"), F.max("stop").alias("_last"))
    times = clips.select(*keys, F.explode(F.array("start", "stop")).alias("at")).distinct().join(ends, keys).where("at > _first and at < _last").select(*keys, "at")
    seen = iv.visible(times.select(*keys, F.explode(F.array(F.col("at") - 1, F.col("at"))).alias("at")).distinct(), clips, keys, width)
    seen = seen.join(clips.select(*keys, "id", F.struct(F.col(source).alias("source"), (F.col("source_in") - F.col("start")).alias("offset")).alias("plays")), [*keys, "id"])
    after = seen.select(*keys, "at", F.col("id").alias("after"), F.col("plays").alias("_b"))
    before = seen.select(*keys, (F.col("at") + 1).alias("at"), F.col("id").alias("before"), F.col("plays").alias("_a"))
    both = times.join(before, [*keys, "at"], "left").join(after, [*keys, "at"], "left").where("not (before <=> after)")
    same = F.coalesce((F.col("_a.source") == F.col("_b.source")) & (F.col("_a.offset") == F.col("_b.offset")), F.lit(False))
    return both.select(*keys, "at", "before", "after", same.alias("continuous"))


def sampled(points: DataFrame, curve: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, at, ...) with the value of a keyed curve (keys, at, value, mode), halves away from zero.

    Before the first key and after the last their values hold; a key's mode (hold, linear, ease_in, ease_out,
    ease_in_out) rules up to the next one. Keys of one time: the one with the greatest value counts. Points of a
    key without a curve have no value. Arithmetic is exact."""
    one = curve.groupBy(*keys, "at").agg(F.max(F.struct("value", "mode")).alias("k"))
    w = _by(keys, "at")
    spans = one.select(*keys, "at", F.struct(F.col("at"), "k", F.lead("at").over(w).alias("to"), F.lead("k.value").over(w).alias("next")).alias("_span"))
    first = one.groupBy(*keys).agg(F.min_by("k.value", "at").alias("_first"))
    own = iv.as_of(points, spans, keys, "_span").join(first, keys, "left")
    wide = lambda c: c.cast("decimal(18,0)")
    n, d, mode = wide(F.col("at") - F.col("_span.at")), wide(F.col("_span.to") - F.col("_span.at")), F.col("_span.k.mode")
    square = lambda x: (x * x).cast("decimal(28,0)")
    late = square(d - n)
    top = F.when(mode == "linear", (n * d).cast("decimal(28,0)")).when(mode == "ease_in", square(n)).when(mode == "ease_out", square(d) - late)
    top = top.when((mode == "ease_in_out") & (n * 2 <= d), square(n) * 2).when(mode == "ease_in_out", square(d) - late * 2)
    a, b = F.col("_span.k.value").cast("decimal(9,0)"), F.col("_span.next").cast("decimal(9,0)")
    low = square(d)
    total = (a * (low - top) + b * top).cast("decimal(37,0)")
    twice = F.abs(total) * 2 + low
    half = ((twice - twice % (low * 2)) / (low * 2)).cast("long")
    between = F.when(total < 0, -half).otherwise(half)
    held = F.col("_span.to").isNull() | (mode == "hold")
    value = F.when(F.col("_span").isNull(), F.col("_first")).when(held, F.col("_span.k.value")).otherwise(between)
    return own.withColumn("value", value.cast("long")).drop("_span", "_first")


def spread(rows: DataFrame, n: int) -> DataFrame:
    """n times of each interval, each in the middle of an n-th: index, and exactly num / den ticks."""
    own = rows.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    num = F.col("start") * (2 * n) + (F.col("index") * 2 + 1) * (F.col("stop") - F.col("start"))
    return own.withColumns({"num": num, "den": F.lit(2 * n)})


def pauses(speech: DataFrame, keys: list[str], start: Column, stop: Column, least: int, keep: int, grid: int, bridge: int) -> DataFrame:
    """Pauses around speech and what of them to cut: keys, start, stop, kind, cut_start, cut_stop (null: too short).

    Speech with gaps below bridge is one region. Edges count from `least` ticks on. A cut leaves keep ticks beside
    speech and lies on whole grid steps within the pause."""
    own = iv.merged(speech, keys, bridge).select(*keys, F.col("start").alias("s"), F.col("stop").alias("e"))
    w = _by(keys, "s")
    between = own.select(*keys, F.lag("e").over(w).alias("start"), F.col("s").alias("stop"), F.lit("between").alias("kind")).where("start is not null")
    ends = own.groupBy(*keys).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    leading = ends.select(*keys, start.alias("start"), F.col("s").alias("stop"), F.lit("leading").alias("kind"))
    trailing = ends.select(*keys, F.col("e").alias("start"), stop.alias("stop"), F.lit("trailing").alias("kind"))
    found = between.unionByName(leading.unionByName(trailing).where(F.col("stop") - F.col("start") >= least))
    up = lambda c: (F.ceil(c / grid) * grid).cast("long")
    down = lambda c: (F.floor(c / grid) * grid).cast("long")
    a = up(F.col("start") + F.when(F.col("kind") == "leading", 0).otherwise(keep))
    b = down(F.col("stop") - F.when(F.col("kind") == "trailing", 0).otherwise(keep))
    return found.withColumns({"cut_start": F.when(a < b, a), "cut_stop": F.when(a < b, b)})


def promoted(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Sequential clips on two tracks, a picture and a sound that one link ties: kind and link are added."""
    return placed.withColumn("kind", F.explode(F.array(F.lit("video"), F.lit("audio")))).withColumn("link", F.concat_ws("-", *keys, "id"))


def lint(clips: DataFrame, assets: DataFrame, keys: list[str], source: str, shortest: int) -> DataFrame:
    """What is amiss: issue, subject (an id), n. Issues are black (holes of a track), flash_frame, missing_media, unused_asset.

    A hole's subject is the id of the clip behind it. n is the length in ticks, or the number of clips."""
    before = F.max("stop").over(_by(keys, "start", "stop").rowsBetween(W.Window.unboundedPreceding, -1))
    gap = clips.withColumn("n", F.col("start") - before).where("n > 0").select(F.lit("black").alias("issue"), F.col("id").alias("subject"), "n")
    length = F.col("stop") - F.col("start")
    short = clips.where(length < shortest).select(F.lit("flash_frame").alias("issue"), F.col("id").alias("subject"), length.alias("n"))
    used = clips.groupBy(F.col(source).alias("subject")).agg(F.count("*").alias("n")).join(assets.select(F.col(source).alias("_asset")).distinct(), F.col("subject") == F.col("_asset"), "full_outer")
    other = used.where("_asset is null or subject is null").select(F.when(F.col("_asset").isNull(), "missing_media").otherwise("unused_asset").alias("issue"), F.coalesce("subject", "_asset").alias("subject"), F.coalesce("n", F.lit(0)).alias("n"))
    return gap.unionByName(short).unionByName(other)


def transitions(effects: DataFrame, clips: DataFrame, assets: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Transitions (keys, left_id, right_id, before, after) with start, stop and issue (null: none).

    A transition lasts from `before` ahead of the cut to `after` behind it. Issues: clips (one is missing), apart (they do
    not touch), short (it is longer than a clip), head (the right source does not begin early enough), tail (the left one
    ends too early; assets have source and length)."""
    shape = ["start", "stop", "source_in"]
    left = clips.select(*keys, F.col("id").alias("left_id"), F.struct(*shape, source).alias("_l"))
    right = clips.select(*keys, F.col("id").alias("right_id"), F.struct(*shape).alias("_r"))
    ends = assets.select(F.col(source).alias("_asset"), F.col("length").alias("_length"))
    own = effects.join(left, [*keys, "left_id"], "left").join(right, [*keys, "right_id"], "left").join(ends, F.col(f"_l.{source}") == F.col("_asset"), "left")
    length = lambda c: F.col(f"{c}.stop") - F.col(f"{c}.start")
    issue = (
        F.when(F.col("_l").isNull() | F.col("_r").isNull(), "clips")
        .when(F.col("_l.stop") != F.col("_r.start"), "apart")
        .when((F.col("before") > length("_l")) | (F.col("after") > length("_r")), "short")
        .when(F.col("_r.source_in") < F.col("before"), "head")
        .when(F.col("_l.source_in") + length("_l") + F.col("after") > F.col("_length"), "tail")
    )
    at = F.col("_r.start")
    return own.select(*effects.columns, (at - F.col("before")).alias("start"), (at + F.col("after")).alias("stop"), issue.alias("issue"))


def crossing(clips: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Clips that reach beyond both ends of [start, stop): a cut there leaves two parts, and the second needs an id."""
    return clips.where((F.col("start") < start) & (F.col("stop") > stop))


def fresh_ids(rows: DataFrame, used: DataFrame, keys: list[str], order: str, base: Column) -> DataFrame:
    """rows with a column fresh: base-j1, base-j2 and so on in order, leaving out those that used (keys, id) has.

    A key gets as many candidates as it has rows and used ids of that form, so there is always a free one for each row."""
    own = rows.withColumn("_base", base)
    own = own.withColumn("_n", F.row_number().over(_by([*keys, "_base"], order)))
    need = own.groupBy(*keys, "_base").agg(F.max("_n").alias("_need"))
    taken = used.select(*keys, F.col("id").alias("fresh")).distinct().withColumn("_base", F.regexp_extract("fresh", "^(.*)-j[0-9]+$", 1))
    need = need.join(taken.groupBy(*keys, "_base").agg(F.count("*").alias("_taken")), [*keys, "_base"], "left")
    names = need.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_need") + F.coalesce("_taken", F.lit(0)))))
    names = names.select(*keys, "_base", "_j", F.concat("_base", F.lit("-j"), F.col("_j").cast("string")).alias("fresh"))
    free = names.join(taken.drop("_base"), [*keys, "fresh"], "left_anti")
    free = free.withColumn("_n", F.row_number().over(_by([*keys, "_base"], "_j"))).drop("_j")
    return own.join(free, [*keys, "_base", "_n"]).drop("_n", "_base")


def load(windows: DataFrame, clips: DataFrame, keys: list[str], width: int) -> DataFrame:
    """How many clips each window (keys, start, stop) meets: keys, start, stop, clips; windows without any have 0."""
    own = windows.select(*keys, "start", "stop")
    met = iv.overlap_join(own, clips.select(*keys, "start", "stop"), keys, width).groupBy(*keys, "start", "stop").agg(F.count("*").alias("_n"))
    return own.distinct().join(met, [*keys, "start", "stop"], "left").select(*keys, "start", "stop", F.coalesce("_n", F.lit(0)).alias("clips"))


#: Steps of a batch that stay in one plan.
STRIDE = 20


def applied(clips: DataFrame, steps: list, violations) -> DataFrame:
    """All steps (DataFrame to DataFrame), one behind another, or none: raises ValueError if violations of the result has a row.

    1 to 1000 steps. After each STRIDE steps the rows are written to the shared folder, so that no plan grows with their
    number; nothing is given out before the check."""
    if not 1 <= len(steps) <= 1000:
        raise ValueError("1 to 1000 edits")
    out = clips
    for n, step in enumerate(steps, 1):
        out = step(out)
        if n % STRIDE == 0 and n < len(steps):
            out = written(out, "steps")
    if wrong := violations(out).limit(1).collect():
        raise ValueError(f"the edits leave {wrong[0]}")
    return out
