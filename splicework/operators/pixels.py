"""Pixels as rows: compositing, transitions, shrinking and tone curves, in exact integers.

Pixels have channels from 0 to 255 beside their keys, such as a frame, and stay within codegen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.functions.rational import half_away

RGB = ("r", "g", "b")


def _near(num: Column, den: int | Column) -> Column:
    """num / den, both 0 or more, to the nearest integer, halves up."""
    return F.floor((num * 2 + den) / (F.lit(den) * 2 if isinstance(den, int) else den * 2)).cast("long")


def blended(dest: Column, source: Column, alpha: Column, opacity: Column, mode: Column, premultiplied: bool = False) -> Column:
    """A channel over another, rounded once; mode is normal, multiply or screen; alpha and opacity are from 0 to 255."""
    cover = alpha * opacity
    weighted = source * 255 * opacity if premultiplied else source * cover
    return (
        F.when(mode == "normal", _near(weighted + dest * (65_025 - cover), 65_025))
        .when(mode == "multiply", _near(dest * weighted + dest * 255 * (65_025 - cover), 65_025 * 255))
        .when(mode == "screen", _near(dest * (65_025 * 255) + (F.lit(255) - dest) * weighted, 65_025 * 255))
    )


def stacked(layers: DataFrame, keys: list[str], order: str, ground: int = 0) -> DataFrame:
    """Layers (keys: a pixel; order, r, g, b, a, opacity, mode) laid over a ground, the least order first: keys, r, g, b.

    A pixel has as many rows as its picture has layers."""
    shape = F.struct(F.col(order).alias("_o"), *RGB, "a", "opacity", "mode")
    start = F.struct(*(F.lit(ground).cast("long").alias(c) for c in RGB))
    lay = lambda d, s: F.struct(*(blended(d[c], s[c], s["a"], s["opacity"], s["mode"]).alias(c) for c in RGB))
    own = layers.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(shape)), start, lay).alias("_p"))
    return own.select(*keys, *(f"_p.{c}" for c in RGB))


def transition(kind: str, before: Column, after: Column, index: Column, count: int, x: Column, width: int) -> Column:
    """A channel in frame `index` (from 0) of `count`: kind is dissolve, dip_black, wipe_left or wipe_right.

    Frame i stands at (2 i + 1) / (2 count) of the way; x is the pixel's column of width."""
    k = index * 2 + 1
    if kind == "dissolve":
        return before + F.floor(((after - before) * k + count) / (2 * count)).cast("long")
    if kind == "dip_black":
        return _near(F.when(k > count, after * (k * 2 - 2 * count)).otherwise(before * (F.lit(2 * count) - k * 2)), 2 * count)
    from_edge = x if kind == "wipe_left" else F.lit(width - 1) - x
    return F.when((from_edge * 2 + 1) * count <= k * width, after).otherwise(before)


def shrunk(pixels: DataFrame, keys: list[str], x: str, y: str, by: int) -> DataFrame:
    """Boxes of by * by pixels as one, each channel the mean of those that exist, rounded down: keys, x, y, r, g, b."""
    box = [F.floor(F.col(c) / by).cast("long").alias(c) for c in (x, y)]
    return pixels.groupBy(*keys, *box).agg(*(F.floor(F.sum(c) / F.count("*")).cast("long").alias(c) for c in RGB))


def averaged(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Several pictures of one frame (keys: a pixel), each of equal weight, halves up: keys, r, g, b."""
    return samples.groupBy(*keys).agg(*(_near(F.sum(c), F.count("*")).alias(c) for c in RGB))


def looked_up(pixels: DataFrame, table: list[int]) -> DataFrame:
    """Channels through a curve of evenly spaced values (two at least, from 0 to 255), linear between them, halves up."""
    steps, values = len(table) - 1, F.array(*map(F.lit, table))

    def graded(c: str) -> Column:
        at = F.least(F.floor(F.col(c) * steps / 255), F.lit(steps - 1)).cast("int")
        rest = F.col(c) * steps - at * 255
        return _near(F.get(values, at) * (F.lit(255) - rest) + F.get(values, at + 1) * rest, 255)

    return pixels.withColumns({c: graded(c) for c in RGB})


def band(value: Column, low: int, high: int, soft: int) -> Column:
    """How far a value is in [low, high], in thousandths: falls evenly to 0 over soft at either side, rounded down."""
    out = F.greatest(F.lit(low) - value, value - high, F.lit(0))
    return F.when(out == 0, 1000).when(out >= soft, 0).otherwise(F.floor((F.lit(soft) - out) * 1000 / max(soft, 1))).cast("long")


def crop_path(targets: DataFrame, keys: list[str], index: str, low: str, high: str, target: str, most: int) -> DataFrame:
    """keys, index, at: a position within [low, high] of each frame, at most `most` from the one before, near target.

    What can be reached at a frame is what its own and every later frame's bounds allow: two running bounds from the end.
    The walk itself clamps each target to those and to the step before: a fold in order. Fails where no path exists."""
    w = W.Window.partitionBy(*keys).orderBy(F.col(index).desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    n = F.row_number().over(W.Window.partitionBy(*keys).orderBy(index)).cast("long")
    own = targets.select(*keys, index, F.col(target).alias("_t"), low, high, n.alias("_n"))
    own = own.withColumns({"_low": F.max(F.col(low) - F.col("_n") * most).over(w) + F.col("_n") * most, "_high": F.min(F.col(high) + F.col("_n") * most).over(w) - F.col("_n") * most})
    shape = own.select(*keys, index, F.col("_t").cast("long").alias("at"), F.col("_low").cast("long").alias("_low"), F.col("_high").cast("long").alias("_high"))
    names = [*keys, index, "at"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, path = pdf.sort_values(index), []
        for goal, lo, hi in zip(pdf["at"].tolist(), pdf["_low"].tolist(), pdf["_high"].tolist(), strict=True):
            if path:
                lo, hi = max(lo, path[-1] - most), min(hi, path[-1] + most)
            if lo > hi:
                raise ValueError("no path within the bounds")
            path.append(min(max(goal, lo), hi))
        return pdf.assign(at=path)[names]

    return shape.groupBy(*keys).applyInPandas(fold, shape.select(*names).schema)


def fade(value: Column, gain_milli: Column) -> Column:
    """A sample at a gain, halves away from zero."""
    return half_away(value * gain_milli, F.lit(1000))


def hsl(r: Column, g: Column, b: Column) -> Column:
    """STRUCT of hue (thousandths of a degree; null for grey), saturation and lightness (thousandths), halves away from zero."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    delta, light = high - low, half_away((high + low) * 1000, F.lit(510))
    turn = F.when(high == r, (g - b) * 60_000).when(high == g, (b - r) * 60_000 + delta * 120_000).otherwise((r - g) * 60_000 + delta * 240_000)
    grey = delta == 0
    hue = F.when(~grey, half_away(F.pmod(turn, F.greatest(delta, F.lit(1)) * 360_000), F.greatest(delta, F.lit(1))) % 360_000)
    full = F.when(grey, 1).otherwise(F.lit(255) - F.abs(high + low - 255))
    return F.struct(hue.alias("hue"), F.when(grey, 0).otherwise(half_away(delta * 1000, full)).cast("long").alias("saturation"), light.alias("lightness"))


def qualified(colour: Column, hue: tuple[int, int, int] | None, saturation: tuple[int, int, int] | None, lightness: tuple[int, int, int] | None, inverted: bool = False) -> Column:
    """How far a colour (of hsl) is selected, 0 to 1: the product of its bands. hue is (centre, inner, outer), round the
    circle; the others are (low, high, soft). Grey has no hue and no weight in a hue band."""
    weight = F.lit(1.0)
    if hue:
        centre, inner, outer = hue
        off = F.abs(colour["hue"] - centre)
        off = F.least(off, F.lit(360_000) - off)
        weight = F.when(off.isNull(), 0.0).when(off <= inner, 1.0).when(off >= outer, 0.0).otherwise((F.lit(outer) - off) / max(outer - inner, 1))
    for name, limits in (("saturation", saturation), ("lightness", lightness)):
        if limits:
            low, high, soft = limits
            off = F.greatest(F.lit(low) - colour[name], colour[name] - high, F.lit(0))
            weight = weight * F.when(off == 0, 1.0).when(off >= soft, 0.0).otherwise((F.lit(soft) - off) / max(soft, 1))
    return F.lit(1.0) - weight if inverted else weight


def through_cube(pixels: DataFrame, cube: DataFrame, size: int) -> DataFrame:
    """Pixels through a table of size ** 3 colours (index, r, g, b from 0 to 1; red runs fastest), trilinear, halves up.

    Each different colour is looked up once, by an equality join with its eight neighbours: 16.7 million colours at most."""
    colours = pixels.select(*RGB).distinct()
    at = {c: F.least(F.floor(F.col(c) * (size - 1) / 255), F.lit(size - 2)).cast("long") for c in RGB}
    rest = {c: F.col(c) * (size - 1) / 255 - at[c] for c in RGB}
    corners = []
    for k in range(8):
        bits = {c: k >> i & 1 for i, c in enumerate(RGB)}
        share = F.lit(1.0)
        for c in RGB:
            share = share * (rest[c] if bits[c] else F.lit(1.0) - rest[c])
        corners.append(F.struct((at["r"] + bits["r"] + (at["g"] + bits["g"]) * size + (at["b"] + bits["b"]) * size * size).alias("index"), share.alias("share")))
    near = colours.select(*RGB, F.explode(F.array(*corners)).alias("_c")).select(*RGB, "_c.*").where("share > 0")
    table = cube.select("index", *(F.col(c).alias(f"_{c}") for c in RGB))
    out = near.join(table, "index").groupBy(*RGB).agg(*(F.floor(F.sum(F.col("share") * F.col(f"_{c}")) * 255 + 0.5 + 1e-9).cast("long").alias(f"_{c}") for c in RGB))
    own = pixels.join(out, list(RGB))
    return own.select(*(F.col(f"_{c}").alias(c) if c in RGB else F.col(c) for c in pixels.columns))
