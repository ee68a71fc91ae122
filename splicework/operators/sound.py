"""Sound: mixing, ducking, limiting, filtering, resampling and the alignment of two recordings.

Samples are integers at whole indices beside their keys, such as a track and a channel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.functions.rational import half_away
from splicework.operators import intervals as iv

#: A gain of one.
ONE = 2**32


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def mixed(voices: DataFrame, keys: list[str], index: str, most: int = 32_767) -> DataFrame:
    """Voices (keys, index, value, gain_milli) summed, rounded once (halves away from zero) and held within 16 bits: keys, index, value."""
    total = voices.groupBy(*keys, index).agg(F.sum(F.col("value") * F.col("gain_milli")).alias("_t"))
    value = F.greatest(F.lit(-most - 1), F.least(F.lit(most), half_away(F.col("_t"), F.lit(1000))))
    return total.select(*keys, index, value.cast("long").alias("value"))


def ducked(music: DataFrame, speech: DataFrame, keys: list[str], attack: int, release: int, duck_milli: int, width: int) -> DataFrame:
    """Gain keys that lower music under speech: keys, id, at (source ticks), value, mode.

    Music clips have id, start, stop, source_in and gain_milli; speech regions (keys, start, stop) do not overlap. Each
    region goes down over `attack` before it and up over `release` behind it; ramps that meet become one. Keys outside of
    a clip's source range are left out."""
    widened = speech.select(*keys, (F.col("start") - attack).alias("start"), (F.col("stop") + release).alias("stop"))
    clip = ["id", "start", "stop", "source_in", "gain_milli"]
    hit = iv.overlap_join(music.select(*keys, *clip), widened, keys, width)
    own = hit.select(*keys, "id", F.struct("start", "stop", "source_in", "gain_milli").alias("_clip"), F.col("other_start").alias("start"), F.col("other_stop").alias("stop"))
    spans = iv.merged(own, [*keys, "id", "_clip"])
    gain = F.col("_clip.gain_milli")
    low = F.floor((gain * duck_milli + 500) / 1000).cast("long")
    key = lambda at, value, mode: F.struct(at.alias("at"), value.cast("long").alias("value"), F.lit(mode).alias("mode"))
    down = [key(F.col("start"), gain, "linear")] if attack else []
    up = [key(F.col("stop") - release, low, "linear")] if release else []
    path = F.array(*down, key(F.col("start") + attack, low, "hold"), *up, key(F.col("stop"), gain, "hold"))
    every = spans.select(*keys, "id", "_clip", F.explode(path).alias("_k"))
    at = F.col("_clip.source_in") + F.col("_k.at") - F.col("_clip.start")
    inside = (at >= 0) & (at <= F.col("_clip.source_in") + F.col("_clip.stop") - F.col("_clip.start"))
    return every.where(inside).select(*keys, "id", at.alias("at"), "_k.value", "_k.mode")


def limited(peaks: DataFrame, keys: list[str], index: str, peak: str, ceiling: int, lookahead: int, step: int) -> DataFrame:
    """peaks with the gain (2 ** 32: one) of a look-ahead limiter at each index.

    A peak above the ceiling needs ceiling / peak. The least need of the last `lookahead` + 1 samples holds; from there the
    gain rises by at most step a sample; its mean over lookahead + 1 samples, ones before the first, is the gain. The rise
    is not a recurrence here: the gain is the least of one and of every earlier need plus its steps, a running minimum."""
    w = _by(keys, index)
    need = F.when(F.col(peak) > ceiling, F.expr(f"{ceiling * ONE} div {peak}")).otherwise(F.lit(ONE))
    own = peaks.withColumn("_n", F.row_number().over(w).cast("long")).withColumn("_need", need)
    own = own.withColumn("_held", F.min("_need").over(w.rowsBetween(-lookahead, 0)))
    low = F.min(F.col("_held") - F.col("_n") * step).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    own = own.withColumn("_rise", F.least(F.lit(ONE), low + F.col("_n") * step))
    near = w.rowsBetween(-lookahead, 0)
    total = F.sum("_rise").over(near) + (F.lit(lookahead + 1) - F.count("_rise").over(near)) * ONE
    own = own.withColumn("_sum", total)
    return own.withColumn("gain", F.expr(f"_sum div {lookahead + 1}")).drop("_n", "_need", "_held", "_rise", "_sum")


def filtered(samples: DataFrame, keys: list[str], index: str, value: str, b: tuple[float, float, float], a: tuple[float, float]) -> DataFrame:
    """keys, index, filtered: y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a1 y[n-1] - a2 y[n-2], from rest.

    Each output needs the two before it, so a key's samples are folded in order in one task."""
    shape = samples.select(*keys, index, F.col(value).cast("double").alias("filtered"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for x in pdf["filtered"].tolist():
            y = b[0] * x + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x1, x2, y1, y2 = x, x1, y, y1
            out.append(y)
        return pdf.assign(filtered=out)

    return shape.groupBy(*keys).applyInPandas(fold, shape.schema)


def resampled(samples: DataFrame, keys: list[str], index: str, value: str, rate_in: int, rate_out: int) -> DataFrame:
    """Samples (index without gaps from 0 on) at another rate, linearly between neighbours, halves away from zero: keys, index, value.

    Each sample gives the outputs up to the next one, so nothing is joined; behind the last sample it holds."""
    here = F.col(index)
    after = F.coalesce(F.lead(value).over(_by(keys, index)), F.col(value))
    up = lambda n: F.floor((n + rate_in - 1) / rate_in).cast("long")
    first, end = up(here * rate_out), up((here + 1) * rate_out)
    own = samples.select(*keys, here.alias("_i"), F.col(value).alias("_a"), after.alias("_b"), F.when(first < end, F.sequence(first, end - 1)).alias("_o"))
    own = own.select(*keys, "_i", "_a", "_b", F.explode("_o").alias(index))
    rest = F.col(index) * rate_in - F.col("_i") * rate_out
    return own.select(*keys, index, half_away(F.col("_a") * (rate_out - rest) + F.col("_b") * rest, F.lit(rate_out)).alias("value"))


def correlated(pairs: DataFrame, keys: list[str], index: str, a: str, b: str, lags: range) -> DataFrame:
    """keys, lag, n, score: the normalised correlation of a with b `lag` rows later, over the rows that have both.

    All lags are taken in one pass over one window; sums a key, whatever the number of rows. Null for silence."""
    w = _by(keys, index)

    def later(lag: int) -> Column:
        return (F.lead(b, lag) if lag > 0 else F.lag(b, -lag)).over(w) if lag else F.col(b)

    own = pairs.select(*keys, a, *(later(k).alias(f"_{k}") for k in lags))
    sums = []
    for k in lags:
        x, y = F.col(a), F.col(f"_{k}")
        both = y.isNotNull() & x.isNotNull()
        of = lambda c: F.coalesce(F.sum(F.when(both, c)), F.lit(0))  # noqa: B023, E731
        sums.append(F.struct(F.lit(k).alias("lag"), F.count_if(both).alias("n"), of(x * y).alias("xy"), of(x * x).alias("xx"), of(y * y).alias("yy")).alias(f"_s{k}"))
    every = own.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*(F.col(f"_s{k}") for k in lags))).alias("_s")).select(*keys, "_s.*")
    energy = F.sqrt(F.col("xx").cast("double")) * F.sqrt(F.col("yy").cast("double"))
    return every.select(*keys, "lag", "n", F.when(energy > 0, F.col("xy") / energy).alias("score"))


def separated(scores: DataFrame, keys: list[str], lag: str, score: str, apart: int, margin: float) -> DataFrame:
    """The best lag of each key (the least on ties), and whether it is sure: keys, lag, score, second, sure.

    second is the best score `apart` lags or more away; it must be lower by margin, or be absent."""
    ranked = scores.where(F.col(score).isNotNull())
    best = ranked.groupBy(*keys).agg(F.max_by(lag, F.struct(F.col(score), -F.col(lag))).alias("_best"), F.max(score).alias("_top"))
    far = ranked.join(best, keys).groupBy(*keys, "_best", "_top").agg(F.max(F.when(F.abs(F.col(lag) - F.col("_best")) >= apart, F.col(score))).alias("second"))
    sure = F.coalesce(F.col("_top") - F.col("second") >= margin, F.lit(True))
    return far.select(*keys, F.col("_best").alias("lag"), F.col("_top").alias("score"), "second", sure.alias("sure"))


def beats(strengths: DataFrame, keys: list[str], index: str, strength: str, period: str, tightness: float) -> DataFrame:
    """keys, index of beats: the chain of indices with the greatest total strength (in standard deviations) where a step of
    d costs tightness * ln(d / period) ** 2, for d from half to twice the period; it ends within the last period.

    The best chain to an index needs those before it, so a key's series is folded in order. Constant series have none."""
    import numpy as np

    shape = strengths.select(*keys, index, F.col(strength).cast("double").alias("_s"), F.col(period).cast("double").alias("_p"))
    names = [*keys, index]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        s, p = pdf["_s"].to_numpy(), float(pdf["_p"].iloc[0])
        if not len(s) or s.std() == 0:
            return pdf.head(0)[names]
        s = s / s.std()
        steps = np.arange(max(1, round(p / 2)), round(p * 2) + 1)
        cost = tightness * np.log(steps / p) ** 2
        total, back = s.copy(), np.full(len(s), -1)
        for t in range(int(steps[0]), len(s)):
            n = min(len(steps), t - int(steps[0]) + 1)
            worth = total[t - steps[:n]] - cost[:n]
            k = int(worth.argmax())
            if worth[k] > 0:
                total[t] += worth[k]
                back[t] = t - steps[k]
        tail = max(0, len(s) - round(p))
        at, chain = tail + int(total[tail:].argmax()), []
        while at >= 0:
            chain.append(at)
            at = back[at]
        return pdf.iloc[chain[::-1]][names]

    return shape.groupBy(*keys).applyInPandas(fold, shape.select(*names).schema)
