"""Exact nonnegative rationals STRUCT<num BIGINT, den BIGINT>, up to 2^53 - 1 each.

Products are DECIMAL(38,0), so no intermediate overflows. Values of unlike form but equal size compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND = 2**53 - 1


def _wide(c: Column) -> Column:
    return c.cast("decimal(17,0)")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's fold, in longs where both fit. By Lamé it takes at most five steps a digit of the smaller, and one to put it second."""
    wide = "decimal(38,0)"

    def fold(p: Column, kind: str) -> Column:
        start = F.struct(p["a"].cast(kind).alias("a"), p["b"].cast(kind).alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).cast(kind).alias("b")))
        steps = F.length(F.least(p["a"], p["b"]).cast("string")) * 5 + 2
        return F.aggregate(F.sequence(F.lit(1), steps), start, step)["a"].cast(wide)

    pair = F.array(F.struct(a.cast(wide).alias("a"), b.cast(wide).alias("b")))  # bound, so that both are computed once
    return F.get(F.transform(pair, lambda p: F.when(F.greatest(p["a"], p["b"]) <= 2**63 - 1, fold(p, "long")).otherwise(fold(p, wide))), 0)


def make(num: Column, den: Column) -> Column:
    """num / den in lowest terms."""
    g = gcd(num, den)
    exact = lambda c: ((c.cast("decimal(38,0)") - c.cast("decimal(38,0)") % g) / g).cast("decimal(38,0)").cast("long")
    return F.struct(exact(num).alias("num"), exact(den).alias("den"))


def less(a: Column, b: Column) -> Column:
    return _wide(a["num"]) * _wide(b["den"]) < _wide(b["num"]) * _wide(a["den"])


def equal(a: Column, b: Column) -> Column:
    return _wide(a["num"]) * _wide(b["den"]) == _wide(b["num"]) * _wide(a["den"])


def plus(a: Column, b: Column) -> Column:
    return make(_wide(a["num"]) * _wide(b["den"]) + _wide(b["num"]) * _wide(a["den"]), _wide(a["den"]) * _wide(b["den"]))


def ticks(t: Column, rate: Column) -> Column:
    """t in units of 1 / rate; null where it does not fall on one."""
    num, den = _wide(t["num"]) * _wide(rate["num"]), _wide(t["den"]) * _wide(rate["den"])
    return F.when(num % den == 0, (num / den).cast("decimal(38,0)").cast("long"))


def half_away(num: Column, den: Column) -> Column:
    """num / den to the nearest integer, halves away from zero."""
    size = F.floor((F.abs(num) * 2 + den) / (den * 2))
    return F.when(num < 0, -size).otherwise(size).cast("long")
