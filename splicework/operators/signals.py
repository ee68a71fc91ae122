"""Signals and pictures: loudness profiles, shot cuts, periodicity, clock fits, and colour counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators import ordered


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def decibels(power: Column) -> Column:
    """10 log10 of a power; null for none."""
    return F.when(power > 0, F.log10(power) * 10)


def loudness_profile(blocks: DataFrame, keys: list[str], index: str, power: str, a_second: int = 10) -> DataFrame:
    """Per whole second of blocks (index from 0, mean power each): the short-term loudness of up to three seconds, and the
    greatest of windows of four blocks that end in the second; null below -70. keys, second, short_term, momentary."""
    w = _by(keys, index)
    loud = lambda c: F.when(decibels(c) - 0.691 >= -70, F.round(decibels(c) - 0.691, 1))
    own = blocks.withColumns({
        "_short": F.avg(power).over(w.rowsBetween(1 - 3 * a_second, 0)), "_four": F.when(F.count(power).over(w.rowsBetween(-3, 0)) == 4, F.avg(power).over(w.rowsBetween(-3, 0))),
        "second": F.floor(F.col(index) / a_second),
    })
    whole = own.groupBy(*keys, "second").agg(F.count("*").alias("_n"), F.max_by("_short", index).alias("_short"), F.max("_four").alias("_four"))
    return whole.where(F.col("_n") == a_second).select(*keys, "second", loud(F.col("_short")).alias("short_term"), loud(F.col("_four")).alias("momentary"))


def levels(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Root mean square and peak of samples, and the first in decibels: keys, rms, peak, rms_db."""
    mean = F.avg(F.col(value) * F.col(value))
    return samples.groupBy(*keys).agg(F.sqrt(mean).alias("rms"), F.max(F.abs(F.col(value))).alias("peak"), decibels(mean).alias("rms_db"))


def shot_cuts(frames: DataFrame, keys: list[str], index: str, difference: str, threshold: float, apart: int) -> DataFrame:
    """First frames of shots: frame 0, and frames that differ from the one before by the threshold and by twice as much as
    any of the two frames at either side (frame 0 has no difference), `apart` frames or more behind the last cut."""
    w = _by(keys, index)
    own = F.when(F.col(index) > 0, F.col(difference))
    near = F.greatest(F.lit(0.0), *(f(own, k).over(w) for f in (F.lag, F.lead) for k in (1, 2)))
    cut = (own >= threshold) & (own >= near * 2)
    found = frames.withColumn("_cut", (F.col(index) == 0) | cut).where("_cut")
    return ordered.spaced(found.select(*keys, index), keys, index, apart)


def autocorrelation(series: DataFrame, keys: list[str], index: str, strength: str, lags: range) -> DataFrame:
    """keys, lag, score: the sum of each strength (0 or more) times the greatest of the three around its lag.

    All lags are taken in one pass over one window; no row is copied per lag before the sums."""
    w = _by(keys, index)
    partner = lambda lag: F.greatest(F.lit(0), *(F.lead(strength, k).over(w) for k in (lag - 1, lag, lag + 1)))
    own = series.select(*keys, *((F.col(strength) * partner(k)).alias(f"_{k}") for k in lags))
    sums = own.groupBy(*keys).agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in lags))
    return sums.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("score")) for k in lags))).alias("_s")).select(*keys, "_s.*")


def strongest_lag(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The lag with the greatest score, the least lag on ties."""
    return scores.groupBy(*keys).agg(F.max_by("lag", F.struct("score", -F.col("lag"))).alias("lag"), F.max("score").alias("score"))


def clock_fit(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The clock through the first and last match (source, target): keys, n, rise, run, off: the greatest error times run.

    target = first target + (source - first source) * rise / run, exactly. Keys with one source time have none."""
    first, last = (F.min_by, "first"), (F.max_by, "last")
    ends = matches.groupBy(*keys).agg(*(f("target", F.struct("source", "target")).alias(f"_t_{n}") for f, n in (first, last)), F.min("source").alias("_s_first"), F.max("source").alias("_s_last"), F.count("*").alias("n"))
    ends = ends.where("_s_last > _s_first").withColumns({"rise": F.col("_t_last") - F.col("_t_first"), "run": F.col("_s_last") - F.col("_s_first")})
    off = F.abs((F.col("target") - F.col("_t_first")) * F.col("run") - (F.col("source") - F.col("_s_first")) * F.col("rise"))
    return matches.join(ends, keys).groupBy(*keys, "n", "rise", "run").agg(F.max(off).alias("off"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Luma times 10,000."""
    return r * 2126 + g * 7152 + b * 722


def vectorscope(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rounded chroma of pixels (r, g, b from 0 to 255): keys, cr, cb, n."""
    y = luma(F.col("r"), F.col("g"), F.col("b"))
    chroma = lambda c, k: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col(c) * 10_000 - y + 128 * k + k // 2) / k))).cast("long")
    return pixels.groupBy(*keys, chroma("r", 15_748).alias("cr"), chroma("b", 18_556).alias("cb")).agg(F.count("*").alias("n"))


def waveform(pixels: DataFrame, keys: list[str], index: str, width: int, columns: int) -> DataFrame:
    """Counts of values per column of the picture and plane (red, green, blue, luma): keys, column, plane, value, n."""
    column = F.floor(F.col(index) % width * columns / width).cast("long")
    y = F.floor((luma(F.col("r"), F.col("g"), F.col("b")) + 5_000) / 10_000)
    planes = F.array(*(F.struct(F.lit(n).alias("plane"), v.cast("long").alias("value")) for n, v in (("red", F.col("r")), ("green", F.col("g")), ("blue", F.col("b")), ("luma", y))))
    return pixels.select(*keys, column.alias("column"), F.explode(planes).alias("_p")).groupBy(*keys, "column", "_p.plane", "_p.value").agg(F.count("*").alias("n"))


def steady_line(points: DataFrame, keys: list[str], run: str, within: float = 1.5, least: int = 4) -> DataFrame:
    """A weighted least-squares slope that all runs of a key share, and an intercept: keys, slope, intercept.

    points have run, x, y and w. Twice, points more than `within` off their run's line are dropped, unless fewer than `least`
    would be left. The intercept is that of the heaviest run of two points or more, the least run on ties; keys without
    one, or with a single x in every run, have no row. Three passes of aggregates, nothing comes to the driver."""
    per_key, per_run = W.Window.partitionBy(*keys), W.Window.partitionBy(*keys, "_run")
    kept = lambda c: F.when(F.col("_in"), c)
    own = points.select(*keys, F.col(run).alias("_run"), "x", "y", "w", F.lit(True).alias("_in"))
    for again in range(3):
        total = F.sum(kept(F.col("w"))).over(per_run)
        own = own.withColumns({"_w": total, "_mx": F.sum(kept(F.col("w") * F.col("x"))).over(per_run) / total, "_my": F.sum(kept(F.col("w") * F.col("y"))).over(per_run) / total, "_n": F.count(kept(F.col("w"))).over(per_run)})
        dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
        spread = F.sum(kept(F.col("w") * dx * dx)).over(per_key)
        own = own.withColumn("_slope", F.when(spread > 0, F.sum(kept(F.col("w") * dx * dy)).over(per_key) / spread))
        if again < 2:
            own = own.withColumn("_near", F.col("_in") & F.coalesce(F.abs(dy - F.col("_slope") * dx) <= within, F.lit(True)))
            own = own.withColumn("_in", F.when(F.count(F.when(F.col("_near"), 1)).over(per_key) >= least, F.col("_near")).otherwise(F.col("_in"))).drop("_near")
    line = own.where((F.col("_n") >= 2) & F.col("_in") & F.col("_slope").isNotNull())
    best = line.groupBy(*keys).agg(F.max_by(F.struct("_slope", "_mx", "_my"), F.struct("_w", -F.col("_run"))).alias("_b"))
    return best.select(*keys, F.col("_b._slope").alias("slope"), (F.col("_b._my") - F.col("_b._slope") * F.col("_b._mx")).alias("intercept"))
