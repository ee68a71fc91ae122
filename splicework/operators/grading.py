"""Grades of pixels in linear light, rectangle masks, matching of levels, and frame rates: column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicework.functions.scalars import decoded, encoded, reduced

#: A mask's weight where it covers a pixel wholly; contrast turns about PIVOT.
WHOLE, PIVOT = 65_536, 0.18
# Frame rates that are native.
RATES = ((24, 1), (25, 1), (30, 1), (50, 1), (60, 1), (24_000, 1_001), (30_000, 1_001), (60_000, 1_001))


def coverage(x: Column, y: Column, rect: tuple[int, int, int, int], radius: int = 0, edge: str = "inner", inverted: bool = False) -> Column:
    """The weight (0 to WHOLE) of a rectangle (left, top, width, height) at a pixel.

    A soft edge rises over radius pixels: inside the rectangle's edge (inner), about it (centered) or outside it (outer), by
    the distance of the pixel's middle from the nearest edge, so corners are square. Radius 0 is a hard edge."""
    left, top, width, height = rect
    twice = F.least(2 * (x - left) + 1, 2 * (left + width - x) - 1, 2 * (y - top) + 1, 2 * (top + height - y) - 1)
    if not width or not height:
        own = F.lit(0)
    elif not radius:
        own = F.when(twice > 0, WHOLE).otherwise(0)
    else:
        before, span = {"inner": (0, 2 * radius), "centered": (2 * radius, 4 * radius), "outer": (2 * radius, 2 * radius)}[edge]
        risen = F.greatest(F.lit(0), F.least(twice + before, F.lit(span)))
        own = F.floor((risen * WHOLE + span // 2) / span)
    return (WHOLE - own if inverted else own).cast("long")


def graded(pixels: DataFrame, exposure: float, contrast: float, balance: tuple[float, float, float], weight: Column | None = None) -> DataFrame:
    """Pixels (r, g, b in 0 to 255) after exposure (stops), white balance (a gain a channel) and contrast, in linear light.

    weight (0 to 1) is how much of the grade each pixel takes; without it, all of it."""
    out = {}
    for c, gain in zip("rgb", balance, strict=True):
        light = decoded(F.col(c) / 255.0, "srgb")
        turned = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (light * (gain * 2.0**exposure) - PIVOT) * contrast + PIVOT))
        mixed = turned if weight is None else light * (1 - weight) + turned * weight
        out[c] = F.round(encoded(mixed, "srgb") * 255).cast("long")
    return pixels.withColumns(out)


def levels_match(source: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, matched (0 to 255): each value of source moved so that mean and deviation are those of reference; a flat source is only moved.

    Two aggregates of a few rows; values are then a column expression."""
    stats = lambda df, s: df.groupBy(*keys).agg(F.avg(value).alias(f"_m{s}"), F.stddev_pop(value).alias(f"_d{s}"))
    both = stats(source, "s").join(stats(reference, "r"), keys)
    gain = F.when(F.col("_ds") > 0, F.col("_dr") / F.col("_ds")).otherwise(1.0)
    own = source.select(*keys, value).distinct().join(both, keys)
    matched = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((F.col(value) - F.col("_ms")) * gain + F.col("_mr"))))
    return own.select(*keys, value, matched.cast("long").alias("matched"))


def native_rate(num: Column, den: Column) -> Column:
    """struct(num, den) of a frame rate in lowest terms if it is native, else null."""
    rate = reduced(num, den)
    known = F.array(*(F.struct(F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den")) for n, d in RATES))
    return F.when(F.array_contains(known, rate), rate)


def scaled_nearest(pixels: DataFrame, keys: list[str], size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Pixels (keys, x, y, r, g, b) of pictures of one size at another: each new pixel is the one that its middle falls into.

    Each new column and row asks for one old one, so old pixels are joined with the few columns and rows that ask for them."""
    spark = pixels.sparkSession
    ask = lambda n, m, old, new: spark.createDataFrame([((2 * i + 1) * n // (2 * m), i) for i in range(m)], f"{old} long, {new} long")
    own = pixels.join(F.broadcast(ask(size[0], target[0], "x", "new_x")), "x").join(F.broadcast(ask(size[1], target[1], "y", "new_y")), "y")
    return own.select(*keys, F.col("new_x").alias("x"), F.col("new_y").alias("y"), "r", "g", "b")
