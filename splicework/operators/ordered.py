"""Ordered analytics: runs, windows, gates, greedy spacing and budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _by(keys: list[str], *order) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def runs(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Runs of equal consecutive values: keys, run, value, first, length."""
    w = _by(keys, order)
    own = rows.select(*keys, order, value.alias("value"))
    own = own.withColumn("_new", F.coalesce((~F.lag("value").over(w).eqNullSafe(F.col("value"))).cast("int"), F.lit(1)))
    own = own.withColumn("run", F.sum("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    return own.groupBy(*keys, "run").agg(F.first("value").alias("value"), F.min(order).alias("first"), F.count("*").alias("length"))


def onset_rise(rows: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """How far a level is above the one before, and above the one before that less 3; 0 at least."""
    w = _by(keys, order)
    x = F.col(level)
    rise = F.least(x - F.lag(x, 1).over(w), x - F.lag(x, 2).over(w) + 3)
    return rows.withColumn("rise", F.greatest(F.coalesce(rise, F.lit(0)), F.lit(0)))


def triangular(rows: DataFrame, keys: list[str], order: str, value: str, radius: int) -> DataFrame:
    """Weighted mean of neighbours, weights radius + 1 less their distance, over those that exist, halves away from 0."""
    w = _by(keys, order)
    total, weight = F.lit(0), F.lit(0)
    for d in range(-radius, radius + 1):
        x = F.lag(value, d).over(w) if d > 0 else F.lead(value, -d).over(w) if d < 0 else F.col(value)
        k = radius + 1 - abs(d)
        total, weight = total + F.coalesce(x * k, F.lit(0)), weight + F.when(x.isNotNull(), k).otherwise(0)
    half = F.floor((F.abs(total) * 2 + weight) / (weight * 2))
    return rows.withColumn("smooth", F.when(total < 0, -half).otherwise(half).cast("long"))


def gated_mean(rows: DataFrame, keys: list[str], energy: str, floor: float, relative: float) -> DataFrame:
    """The mean energy of blocks above a floor and above relative times the mean of those: keys, blocks, gated."""
    loud = rows.where(F.col(energy) > floor)
    gate = loud.groupBy(*keys).agg((F.avg(energy) * relative).alias("_gate"))
    return loud.join(gate, keys).where(F.col(energy) > F.col("_gate")).groupBy(*keys).agg(F.count("*").alias("blocks"), F.avg(energy).alias("gated"))


def spaced(rows: DataFrame, keys: list[str], order: str, apart: int) -> DataFrame:
    """Greedy spacing: the first row of a key, then each that is apart or more behind the last one kept.

    Each key's rows are folded in order in one task; the order is the semantics."""
    names = [*keys, order]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for at in sorted(pdf[order]):
            if last is None or at - last >= apart:
                kept.append(at)
                last = at
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(kept) for k in keys}, order: kept})[names]

    return rows.select(*names).groupBy(*keys).applyInPandas(fold, rows.select(*names).schema)


def evicted(entries: DataFrame, keys: list[str], most_bytes: int, most_entries: int) -> DataFrame:
    """Entries that least-recent eviction removes, down to both budgets: the newest stay while both hold."""
    w = _by(keys, F.col("touched").desc(), F.col("key").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    own = entries.withColumns({"_bytes": F.sum("bytes").over(w), "_n": F.count("*").over(w)})
    return own.where((F.col("_bytes") > most_bytes) | (F.col("_n") > most_entries)).drop("_bytes", "_n")


def histogram(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return values.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))


def cdf_match(source: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """For each source value, the first reference value whose cumulative share is as large: keys, value, matched.

    Histograms (keys, value, n) have 256 values a key, so each key's join is small; shares are compared by cross
    multiplication, in integers."""

    def shares(h: DataFrame, name: str) -> DataFrame:
        w = W.Window.partitionBy(*keys)
        cum = F.sum("n").over(w.orderBy("value").rowsBetween(W.Window.unboundedPreceding, 0))
        return h.select(*keys, F.col("value").alias(f"{name}_value"), cum.cast("decimal(19,0)").alias(f"{name}_cum"), F.sum("n").over(w).cast("decimal(19,0)").alias(f"{name}_all"))

    both = shares(source, "s").join(shares(reference, "r"), keys).where("r_cum * s_all >= s_cum * r_all")
    return both.groupBy(*keys, F.col("s_value").alias("value")).agg(F.min("r_value").alias("matched"))
