"""Scalar expressions: exact literals, displays, clock labels, levels, transfer curves, matrices, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splicework.functions.rational import gcd

#: The largest numerator or denominator of a time.
MOST = 2**53 - 1
BIG = "decimal(38,0)"
# Constants of the transfer curves (BT.709, sRGB, PQ, HLG).
PQ = (2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32)
HLG = (0.17883277, 0.28466892, 0.55991073)


def reduced(num: Column, den: Column) -> Column:
    """struct(num, den) as longs without a common factor; null if den is 0 or one of them is above MOST then."""
    # each step of the array is computed once a row
    pair = F.filter(F.array(F.struct(num.cast(BIG).alias("n"), den.cast(BIG).alias("d"))), lambda p: p["d"] > 0)
    pair = F.transform(pair, lambda p: F.struct(p["n"].alias("n"), p["d"].alias("d"), gcd(F.abs(p["n"]), p["d"]).alias("g")))
    low = F.transform(pair, lambda p: F.struct((p["n"] / p["g"]).cast(BIG).alias("num"), (p["d"] / p["g"]).cast(BIG).alias("den")))
    fits = F.filter(low, lambda p: (F.abs(p["num"]) <= MOST) & (p["den"] <= MOST))
    return F.get(F.transform(fits, lambda p: F.struct(p["num"].cast("long").alias("num"), p["den"].cast("long").alias("den"))), 0)


def literal(text: Column) -> Column:
    """The exact value of "5/2", "2.5" or "3" as struct(num, den); null for anything else. Digits only, no sign, no exponent.

    A decimal may have 30 digits in all, trailing zeros of the fraction apart (so fractions down to 2^-30)."""
    ratio = text.rlike(r"^[0-9]{1,18}/[0-9]{1,18}$")
    by = F.split(text, "/")
    fraction = F.regexp_replace(F.regexp_extract(text, r"^[0-9]+\.([0-9]+)$", 1), "0+$", "")
    whole = F.regexp_extract(text, r"^([0-9]+)", 1)
    plain = text.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & (F.length(F.ltrim(whole, F.lit("0"))) + F.length(fraction) <= 30) & (F.length(fraction) <= 30)
    decimal = reduced(F.concat(whole, fraction).cast(BIG), F.rpad(F.lit("1"), F.length(fraction) + 1, F.lit("0")).cast(BIG))
    return F.when(ratio, reduced(F.get(by, F.lit(0)).cast("long"), F.get(by, F.lit(1)).cast("long"))).when(plain, decimal)


def display(num: Column, den: Column) -> Column:
    """49/25, or 3 for 6/2."""
    own = reduced(num, den)
    return F.when(own["den"] == 1, own["num"].cast("string")).otherwise(F.concat(own["num"].cast("string"), F.lit("/"), own["den"].cast("string")))


def stamp_sum(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b or a - b of signed times, struct(num, den); may be negative."""
    big = lambda c: c.cast(BIG)
    return reduced(big(a["num"]) * big(b["den"]) + sign * big(b["num"]) * big(a["den"]), big(a["den"]) * big(b["den"]))


def stamp_times(a: Column, b: Column) -> Column:
    return reduced(a["num"].cast(BIG) * b["num"].cast(BIG), a["den"].cast(BIG) * b["den"].cast(BIG))


def stamp_ticks(a: Column, rate: int) -> Column:
    """Whole ticks of a signed time at so many a second, towards minus infinity; null unless exact."""
    n = a["num"].cast(BIG) * rate
    return F.when(n % a["den"] == 0, (n / a["den"]).cast("long"))


def label(day: Column, text: Column) -> Column:
    """Frames since day 0 of a day and a 25-frame label HH:MM:SS:FF; null if it is no such label, or out of range."""
    parts = [F.regexp_extract(text, r"^([0-9]{2}):([0-9]{2}):([0-9]{2}):([0-9]{2})$", i).try_cast("int") for i in range(1, 5)]
    h, m, s, f = parts
    good = (h < 24) & (m < 60) & (s < 60) & (f < 25) & day.between(0, 1_000_000)
    return F.when(good, (day * 86_400 + h * 3_600 + m * 60 + s) * 25 + f)


def scaled_level(milli: Column, factor: Column) -> Column:
    """A level in thousandths times a factor, rounded, 4,000 at most."""
    return F.least(F.round(milli * factor), F.lit(4_000)).cast("int")


def hundredths(x: Column) -> Column:
    return F.round(x * 100) / 100


def decoded(x: Column, curve: str) -> Column:
    """Linear light of a code in 0 to 1: bt709, srgb, pq (1.0 is 10,000 nits) or hlg (scene light)."""
    if curve == "bt709":
        return F.when(x < 0.081, x / 4.5).otherwise(F.pow((x + 0.099) / 1.099, F.lit(1 / 0.45)))
    if curve == "srgb":
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    if curve == "pq":
        m1, m2, c1, c2, c3 = PQ
        v = F.pow(x, F.lit(1 / m2))
        return F.pow(F.greatest(v - c1, F.lit(0.0)) / (c2 - c3 * v), F.lit(1 / m1))
    a, b, c = HLG
    return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - c) / a) + b) / 12)


def encoded(x: Column, curve: str) -> Column:
    """The code of linear light: the inverse of decoded()."""
    if curve == "bt709":
        return F.when(x < 0.018, x * 4.5).otherwise(1.099 * F.pow(x, F.lit(0.45)) - 0.099)
    if curve == "srgb":
        return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    if curve == "pq":
        m1, m2, c1, c2, c3 = PQ
        v = F.pow(x, F.lit(m1))
        return F.pow((c1 + c2 * v) / (1 + c3 * v), F.lit(m2))
    a, b, c = HLG
    return F.when(x <= 1 / 12, F.sqrt(3 * x)).otherwise(a * F.log(12 * x - b) + c)


def product(a: Column, b: Column) -> Column:
    """The product of two 4 x 4 matrices, arrays of 16 by rows."""
    cell = lambda i: sum((F.get(a, F.floor(i / 4).cast("int") * 4 + k) * F.get(b, F.lit(4 * k) + i % 4) for k in range(1, 4)), F.get(a, F.floor(i / 4).cast("int") * 4) * F.get(b, i % 4))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def rigid_inverse(a: Column) -> Column:
    """The inverse of a 4 x 4 matrix of a rotation and a shift: its rotation transposed, its shift turned back."""
    at = lambda i, k: F.get(a, F.lit(4 * i + k))
    rows = []
    for i in range(3):
        rows += [at(k, i) for k in range(3)] + [-(at(0, i) * at(0, 3) + at(1, i) * at(1, 3) + at(2, i) * at(2, 3))]
    return F.array(*rows, *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))


def slug(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def within(path: Column, folder: Column) -> Column:
    """Whether a path is the folder or lies below it; back slashes are slashes."""
    own, top = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(folder, F.lit("\\"), F.lit("/")), F.lit("/"))
    return (own == top) | own.startswith(F.concat(top, F.lit("/")))
