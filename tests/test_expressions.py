"""Expression graphs against fractions."""

import hashlib
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from splicework.functions import expressions as ex

NODES = {
    "t": ("column", "t"),
    "three": ("literal", (6, 2)),
    "half": ("literal", (1, 2)),
    "zero": ("literal", (0, 1)),
    "v": ("vector", "t", "three"),
    "scaled": ("multiply", "v", "half"),
    "y": ("component", "scaled", "y"),
    "sum": ("add", "t", "y"),
    "less": ("less", "sum", "three"),
    "mod": ("modulo", "t", "half"),
    "floor": ("floor", "t"),
    "low": ("minimum", "t", "three"),
    "high": ("maximum", "t", "three"),
    "same": ("equal", "floor", "t"),
    "both": ("and", "less", "same"),
    "neither": ("not", "both"),
    "chosen": ("select", "neither", "sum", "mod"),
}


def fraction(v):
    return Fraction(v["num"], v["den"])


def test_graph_against_fractions(spark):
    times = [(7, 3), (-7, 3), (4, 2), (0, 5), (-1, 4), (10**9, 7), (5, 10**6)]
    rows = spark.createDataFrame([((n, d),) for n, d in times], "t struct<num: long, den: long>")
    got = ex.evaluated(rows, NODES, ["scaled", "mod", "floor", "low", "high", "both", "chosen"]).collect()
    for (n, d), r in zip(times, got, strict=True):
        t, half = Fraction(n, d), Fraction(1, 2)
        total, mod = t + Fraction(3, 2), t - half * floor(t / half)
        both = total < 3 and floor(t) == t
        assert r["error"] is None and (fraction(r["scaled"]["x"]), fraction(r["scaled"]["y"])) == (t / 2, Fraction(3, 2))
        assert (fraction(r["mod"]), fraction(r["floor"]), fraction(r["low"]), fraction(r["high"]), r["both"]) == (mod, floor(t), min(t, 3), max(t, 3), both)
        assert fraction(r["chosen"]) == (mod if both else total) and r["chosen"]["den"] == (mod if both else total).denominator


def test_errors_count_in_arms_not_taken(spark):
    rows = spark.createDataFrame([((0, 1),), ((2, 1),), (None,)], "t struct<num: long, den: long>")
    nodes = {"t": ("column", "t"), "one": ("literal", (1, 1)), "d": ("divide", "one", "t"), "yes": ("literal", True), "s": ("select", "yes", "one", "d")}
    assert [(r["s"] and fraction(r["s"]), r["error"]) for r in ex.evaluated(rows, nodes, ["s"]).collect()] == [(None, "domain"), (1, None), (1, None)]
    deep = {"t": ("column", "t"), "big": ("literal", (2**53 - 1, 1)), "p": ("multiply", "big", "t"), "m": ("modulo", "big", "t")}
    assert [r["error"] for r in ex.evaluated(rows, deep, ["p"]).collect()] == ["domain", "precision", None]


def test_seeded_is_a_hash(spark):
    rows = spark.createDataFrame([((5, 1),), ((70_000, 1),), ((1, 2),), ((-1, 1),)], "t struct<num: long, den: long>")
    got = ex.evaluated(rows, {"t": ("column", "t"), "s": ("seeded", 3, "t")}, ["s"], seed=9, tag=b"x\0").collect()
    want = [Fraction(int.from_bytes(hashlib.sha256(b"x\0" + (9).to_bytes(8, "little") + (3).to_bytes(4, "little") + i.to_bytes(4, "little")).digest()[:4], "little"), 2**32) for i in (5, 70_000)]
    assert [fraction(r["s"]) for r in got[:2]] == want and [r["error"] for r in got] == [None, None, "domain", "domain"]


@pytest.mark.parametrize("nodes", [
    {"a": ("link", "b"), "b": ("link", "a")}, {"a": ("link", "b")}, {}, {"a": ("literal", True), "b": ("add", "a", "a")},
    {"a": ("literal", (1, 1)), "v": ("vector", "a", "a"), "b": ("add", "a", "v")}, {"a": ("literal", (1, 1)), "b": ("select", "a", "a", "a")},
])
def test_what_is_no_graph_is_refused(nodes):
    with pytest.raises(ValueError):
        ex.ordered_kinds(nodes)


def test_bounds_hold_before_rounding(spark):
    v = lambda n, d: F.struct(F.lit(n).alias("num"), F.lit(d).alias("den"))
    r = spark.range(1).select(*(ex.bound(v(n, d), -2, 255).alias(f"c{i}") for i, (n, d) in enumerate([(5, 2), (-3, 2), (511, 2), (-5, 2), (255, 1)]))).first()
    assert list(r) == [3, -2, None, None, 255]
