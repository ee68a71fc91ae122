"""Queries of grades, masks, matched levels and rates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicework.operators import grading
from splicework.plans.adapters import read
from splicework.plans.media_queries import _RGB, _rgb
from splicework.plans.queries import _PIX, _pixels, query


def _light(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _code(x: str) -> str:
    return f"round(255 * CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, 1 / 2.4::DOUBLE) - 0.055 END)::BIGINT"


def _graded(weight: str) -> str:
    turned = lambda c, gain: f"greatest(0, least(1, (l{c} * {gain * 2**0.5!r}::DOUBLE - 0.18) * 1.2 + 0.18))"
    mixed = ", ".join(f"l{c} * (1 - w) + {turned(c, g)} * w AS m{c}" for c, g in zip("rgb", (1.1, 1.0, 0.9), strict=True))
    return f"""l AS (SELECT vec_id, i, {', '.join(f'{_light(c)} AS l{c}' for c in 'rgb')}, {weight} AS w FROM rgb), m AS (SELECT vec_id, i, {mixed} FROM l) SELECT vec_id, i, {', '.join(f"{_code('m' + c)} AS {c}" for c in 'rgb')} FROM m"""


@query(f"WITH {_RGB}, {_graded('1.0::DOUBLE')}")
def k1_grade(spark, sf_dir):
    """Half a stop, warmer, with more contrast."""
    return grading.graded(_rgb(spark, sf_dir), 0.5, 1.2, (1.1, 1.0, 0.9)).select("vec_id", "i", "r", "g", "b")


_AT = "least(2 * (i % 8 - 1) + 1, 2 * (1 + 5 - i % 8) - 1, 2 * (i // 8) + 1, 2 * (2 - i // 8) - 1)"


@query(f"WITH {_RGB}, {_graded(f'((greatest(0, least({_AT} + 4, 8)) * 65536 + 4) // 8) / 65536.0::DOUBLE * 0.75')}")
def k2_selective(spark, sf_dir):
    """The same grade within a soft rectangle, at three quarters."""
    i = F.col("i").cast("long")
    weight = grading.coverage(i % 8, F.expr("i div 8"), (1, 0, 5, 2), 2, "centered") / 65_536.0 * 0.75
    return grading.graded(_rgb(spark, sf_dir), 0.5, 1.2, (1.1, 1.0, 0.9), weight).select("vec_id", "i", "r", "g", "b")


_D = "least(2 * (x - 3) + 1, 2 * (3 + 10 - x) - 1, 2 * (y - 2) + 1, 2 * (2 + 6 - y) - 1)"


@query(f"""WITH p AS (SELECT event_id AS id, event_id % 20 AS x, event_id // 20 % 12 AS y FROM events), d AS (SELECT *, {_D} AS d FROM p)
  SELECT id, CASE WHEN d > 0 THEN 65536 ELSE 0 END AS hard, (greatest(0, least(d, 6)) * 65536 + 3) // 6 AS inner_, (greatest(0, least(d + 6, 12)) * 65536 + 6) // 12 AS centered, 65536 - (greatest(0, least(d + 6, 6)) * 65536 + 3) // 6 AS outside FROM d""")
def k6_mask(spark, sf_dir):
    """A rectangle's weight with a hard edge and three soft ones, the last turned round."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    x, y, rect = F.col("id") % 20, F.expr("id div 20 % 12"), (3, 2, 10, 6)
    return e.select("id", grading.coverage(x, y, rect).alias("hard"), grading.coverage(x, y, rect, 3).alias("inner_"), grading.coverage(x, y, rect, 3, "centered").alias("centered"), grading.coverage(x, y, rect, 3, "outer", True).alias("outside"))


@query(f"""WITH {_PIX}, s AS (SELECT channel, value FROM px WHERE vec_id % 2 = 0), r AS (SELECT channel, value FROM px WHERE vec_id % 2 = 1), a AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS d FROM s GROUP BY channel), b AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS d FROM r GROUP BY channel)
  SELECT DISTINCT s.channel, s.value, greatest(0, least(255, round((s.value - a.m) * CASE WHEN a.d > 0 THEN b.d / a.d ELSE 1 END + b.m)))::BIGINT AS matched FROM s JOIN a USING (channel) JOIN b USING (channel)""")
def agg5_levels(spark, sf_dir):
    """Values moved so that mean and deviation match a reference's."""
    p = _pixels(spark, sf_dir)
    return grading.levels_match(p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1"), ["channel"], "value")


@query(f"""WITH t AS (SELECT p_partkey AS k, [24, 25, 30, 50, 60, 24000, 30000, 15][(p_partkey % 8 + 1)::INT] * (p_partkey % 3 + 1) AS n, CASE WHEN p_partkey % 8 IN (5, 6) THEN 1001 ELSE 1 END * (p_partkey % 3 + 1) AS d FROM part)
  SELECT k, CASE WHEN p_ok THEN n // gcd(n, d) END AS num, CASE WHEN p_ok THEN d // gcd(n, d) END AS den FROM (SELECT *, (n // gcd(n, d), d // gcd(n, d)) IN ({', '.join(str(r) for r in grading.RATES)}) AS p_ok FROM t)""")
def s8_rates(spark, sf_dir):
    """Frame rates in lowest terms, where they are native."""
    k = F.col("p_partkey")
    n = F.element_at(F.array(*map(F.lit, (24, 25, 30, 50, 60, 24_000, 30_000, 15))), (k % 8 + 1).cast("int"))
    d = F.when((k % 8).isin(5, 6), 1001).otherwise(1)
    own = read(spark, sf_dir, "part").select(k.alias("k"), grading.native_rate((n * (k % 3 + 1)).cast("long"), (d * (k % 3 + 1)).cast("long")).alias("r"))
    return own.select("k", "r.num", "r.den")


@query(f"""WITH {_RGB}, p AS (SELECT vec_id, i % 7 AS x, i // 7 AS y, r, g, b FROM rgb), c AS (SELECT unnest(range(4)) AS nx), l AS (SELECT unnest(range(5)) AS ny)
  SELECT vec_id, nx AS x, ny AS y, r, g, b FROM c, l, p WHERE p.x = (2 * nx + 1) * 7 // 8 AND p.y = (2 * ny + 1) * 3 // 10""")
def k7_nearest(spark, sf_dir):
    """Pictures of seven by three pixels at four by five."""
    i = F.col("i").cast("long")
    own = _rgb(spark, sf_dir).select("vec_id", (i % 7).alias("x"), F.expr("cast(i as bigint) div 7").alias("y"), "r", "g", "b")
    return grading.scaled_nearest(own, ["vec_id"], (7, 3), (4, 5))
