"""Queries of sound and pixel operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators import intervals as iv
from splicework.operators import pixels, signals, sound
from splicework.plans.adapters import CLIPS, WIDTH, clips, read
from splicework.plans.media_queries import _RGB, _rgb
from splicework.plans.queries import _LEVEL, _MERGED, HOUR, TRACK, _levels, query
from splicework.sources import media

#: A sample is a level; samples of a track follow each other by event.
_SAMPLES = f"{_LEVEL}, sm AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY id) - 1 AS k, db AS v FROM lv)"


def _samples(spark, sf_dir) -> DataFrame:
    k = F.row_number().over(W.Window.partitionBy("track").orderBy("id")) - 1
    return _levels(spark, sf_dir).select("track", k.cast("long").alias("k"), F.col("db").alias("v"))


@query(f"WITH {CLIPS}, t AS (SELECT track % 8 AS bus, start // 360 AS k, sum((round(value * 100)::BIGINT * 200 - 9000) * (400 + id % 5 * 150)) AS t FROM clips GROUP BY ALL) SELECT bus, k, greatest(-32768, least(32767, sign(t) * ((2 * abs(t) + 1000) // 2000)))::BIGINT AS value FROM t")
def agg17_mix(spark, sf_dir):
    """Voices of a bus mixed at their gains, held within 16 bits."""
    c = clips(spark, sf_dir)
    voices = c.select((F.col("track") % 8).alias("bus"), F.floor(F.col("start") / 360).alias("k"), (F.round(F.col("value") * 100).cast("long") * 200 - 9000).alias("value"), (F.col("id") % 5 * 150 + 400).alias("gain_milli"))
    return sound.mixed(voices, ["bus"], "k")


@query(f"""WITH {CLIPS}, sp AS (SELECT * FROM clips WHERE layer = 0), {_MERGED.format(rows='sp', test='>= 180')},
  h AS (SELECT c.track, c.id, c.start AS cs, c.stop AS ce, c.source_in AS si, 500 + c.id % 4 * 100 AS g, u.start - 60 AS a, u.stop + 90 AS z FROM clips c JOIN u ON c.layer = 1 AND u.track = c.track AND u.start - 60 < c.stop AND c.start < u.stop + 90),
  n AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY track, id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM h),
  sp2 AS (SELECT track, id, cs, ce, si, g, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY track, id ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM n) GROUP BY track, id, cs, ce, si, g, i),
  k AS (SELECT *, unnest([(a, g, 'linear'), (a + 60, (g * 300 + 500) // 1000, 'hold'), (z - 90, (g * 300 + 500) // 1000, 'linear'), (z, g, 'hold')]) AS k FROM sp2)
  SELECT track, id, si + k[1] - cs AS at, k[2] AS value, k[3] AS mode FROM k WHERE si + k[1] - cs BETWEEN 0 AND si + ce - cs""")
def int32_duck(spark, sf_dir):
    """Gain keys that lower clips of one layer under speech on another."""
    c = clips(spark, sf_dir)
    speech = iv.merged(c.where("layer = 0"), TRACK, HOUR).drop("members")
    music = c.where("layer = 1").withColumn("gain_milli", F.col("id") % 4 * 100 + 500)
    return sound.ducked(music, speech, TRACK, 60, 90, 300, WIDTH)


@query(f"""WITH {_SAMPLES}, n AS (SELECT track, k, CASE WHEN abs(v) * 50 > 3000 THEN (3000 * 4294967296) // (abs(v) * 50) ELSE 4294967296 END AS need FROM sm),
  h AS (SELECT track, k, min(need) OVER (PARTITION BY track ORDER BY k ROWS 3 PRECEDING) AS held FROM n),
  r AS (SELECT a.track, a.k, least(4294967296, min(b.held + (a.k - b.k) * 100000000)) AS r FROM h a JOIN h b ON b.track = a.track AND b.k <= a.k GROUP BY ALL)
  SELECT track, k, ((sum(r) OVER w + (4 - count(*) OVER w) * 4294967296) // 4)::BIGINT AS gain FROM r WINDOW w AS (PARTITION BY track ORDER BY k ROWS 3 PRECEDING)""")
def win15_limiter(spark, sf_dir):
    """The gain of a look-ahead limiter over each track's samples."""
    peaks = _samples(spark, sf_dir).select("track", "k", (F.abs("v") * 50).alias("peak"))
    return sound.limited(peaks, TRACK, "k", "peak", 3000, 3, 100_000_000).select("track", "k", "gain")


@query(f"""WITH RECURSIVE {_SAMPLES}, f AS (SELECT track, k, v::DOUBLE AS x, v::DOUBLE * 0.2 AS y, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1 FROM sm WHERE k = 0
  UNION ALL SELECT sm.track, sm.k, sm.v::DOUBLE, 0.2 * sm.v + 0.4 * f.x + 0.2 * f.x1 + 0.3 * f.y - 0.1 * f.y1, f.x, f.y FROM f JOIN sm ON sm.track = f.track AND sm.k = f.k + 1) SELECT track, k, round(y, 6) AS filtered FROM f""")
def win14_biquad(spark, sf_dir):
    """Each track's samples through a second-order filter."""
    own = sound.filtered(_samples(spark, sf_dir), TRACK, "k", "v", (0.2, 0.4, 0.2), (-0.3, 0.1))
    return own.withColumn("filtered", F.round("filtered", 6))


@query(f"""WITH {_SAMPLES}, p AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY track ORDER BY k), v) AS z FROM sm), o AS (SELECT *, unnest(range((k * 441 + 159) // 160, ((k + 1) * 441 + 159) // 160)) AS o FROM p),
  n AS (SELECT track, o, v * (441 - (o * 160 - k * 441)) + z * (o * 160 - k * 441) AS t FROM o) SELECT track, o AS k, (sign(t) * ((2 * abs(t) + 441) // 882))::BIGINT AS value FROM n""")
def k17_resample(spark, sf_dir):
    """Samples at 441 / 160 of their rate."""
    return sound.resampled(_samples(spark, sf_dir), TRACK, "k", "v", 160, 441)


_LAGS = range(-6, 7)
_CORRELATED = f"""{_SAMPLES}, pr AS (SELECT track, k, v - 500 AS a, lag(v, 2) OVER (PARTITION BY track ORDER BY k) - 500 + k % 3 * 40 AS b FROM sm),
c AS (SELECT x.track, l AS lag, count(y.b) AS n, sum(x.a * y.b)::DOUBLE AS xy, sum(x.a * x.a) FILTER (y.b IS NOT NULL)::DOUBLE AS xx, sum(y.b * y.b)::DOUBLE AS yy
  FROM pr x CROSS JOIN range(-6, 7) g(l) LEFT JOIN pr y ON y.track = x.track AND y.k = x.k + l GROUP BY ALL),
sc AS (SELECT track, lag::INTEGER AS lag, n, CASE WHEN sqrt(xx) * sqrt(yy) > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END AS score FROM c)"""


def _correlated(spark, sf_dir) -> DataFrame:
    late = F.lag("v", 2).over(W.Window.partitionBy("track").orderBy("k")) - 500 + F.col("k") % 3 * 40
    pairs = _samples(spark, sf_dir).select("track", "k", (F.col("v") - 500).alias("a"), late.alias("b"))
    return sound.correlated(pairs, TRACK, "k", "a", "b", _LAGS)


@query(f"WITH {_CORRELATED} SELECT track, lag, n, round(score, 9) AS score FROM sc")
def win12_correlation(spark, sf_dir):
    """Normalised correlation of two recordings at each lag."""
    return _correlated(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"""WITH {_CORRELATED}, r AS (SELECT track, lag, round(score, 9) AS score FROM sc WHERE score IS NOT NULL), b AS (SELECT track, arg_max(lag, (score, -lag)) AS best, max(score) AS top FROM r GROUP BY track)
  SELECT b.track, best AS lag, top AS score, max(score) FILTER (abs(lag - best) >= 3) AS second, coalesce(top - max(score) FILTER (abs(lag - best) >= 3) >= 0.05, true) AS sure FROM b JOIN r ON r.track = b.track GROUP BY b.track, best, top""")
def ord4_sync(spark, sf_dir):
    """The lag at which two recordings agree best, and whether it is sure."""
    return sound.separated(_correlated(spark, sf_dir).withColumn("score", F.round("score", 9)), TRACK, "lag", "score", 3, 0.05)


@query()
def win9_beats(spark, sf_dir):
    """Beats of each track at the period that its strongest lag gives."""
    s = _samples(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 500, F.lit(0)))
    period = signals.strongest_lag(signals.autocorrelation(s, TRACK, "k", "v", range(2, 13)), TRACK).select("track", F.col("lag").alias("period"))
    return sound.beats(s.join(period, "track"), TRACK, "k", "v", "period", 5.0)


def _mode(c) -> Column:
    return F.element_at(F.array(*map(F.lit, ("normal", "multiply", "screen"))), (c % 3 + 1).cast("int"))


_OVER = """CASE WHEN m = 0 THEN (2 * (s * k + d * (65025 - k)) + 65025) // 130050 WHEN m = 1 THEN (2 * (d * s * k + 255 * d * (65025 - k)) + 16581375) // 33162750 ELSE (2 * (d * 16581375 + (255 - d) * s * k) + 16581375) // 33162750 END"""


@query(f"""WITH {_RGB}, l AS (SELECT vec_id, i, r, g, (b + i) % 256 * (200 - i) AS k, (vec_id + i) % 3 AS m FROM rgb) SELECT vec_id, i, {_OVER} AS value FROM (SELECT vec_id, i, k, m, r AS s, g AS d FROM l)""")
def k5_blend(spark, sf_dir):
    """A channel blended over another in three modes."""
    i = F.col("i")
    alpha, opacity, mode = (F.col("b") + i) % 256, F.lit(200) - i, _mode(F.col("vec_id") + i)
    return _rgb(spark, sf_dir).select("vec_id", "i", pixels.blended(F.col("g"), F.col("r"), alpha, opacity, mode).alias("value"))


@query(f"""WITH RECURSIVE {_RGB}, l AS (SELECT vec_id // 4 AS frame, i, vec_id % 4 AS z, r, g, b, 100 + vec_id % 4 * 40 AS a FROM rgb), o AS (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY z) AS n FROM l),
  f AS (SELECT DISTINCT frame, i, 0::BIGINT AS n, 0::BIGINT AS r, 0::BIGINT AS g, 0::BIGINT AS b FROM l UNION ALL SELECT o.frame, o.i, o.n, {', '.join(f"(2 * (o.{c} * o.a * 180 + f.{c} * (65025 - o.a * 180)) + 65025) // 130050" for c in 'rgb')} FROM f JOIN o ON o.frame = f.frame AND o.i = f.i AND o.n = f.n + 1)
  SELECT frame, i, arg_max(r, n) AS r, arg_max(g, n) AS g, arg_max(b, n) AS b FROM f GROUP BY ALL""")
def k8_stack(spark, sf_dir):
    """Four layers of each picture laid over black."""
    v = F.col("vec_id")
    layers = _rgb(spark, sf_dir).select(F.floor(v / 4).alias("frame"), "i", (v % 4).alias("z"), "r", "g", "b", (v % 4 * 40 + 100).alias("a"), F.lit(180).alias("opacity"), F.lit("normal").alias("mode"))
    return pixels.stacked(layers, ["frame", "i"], "z")


@query(f"""WITH {_RGB}, t AS (SELECT *, vec_id % 12 AS f, 2 * (vec_id % 12) + 1 AS k FROM rgb)
  SELECT vec_id, i, r + floor(((g - r) * k + 12) / 24)::BIGINT AS dissolve, (2 * CASE WHEN k > 12 THEN g * (2 * k - 24) ELSE r * (24 - 2 * k) END + 24) // 48 AS dip, CASE WHEN (2 * i + 1) * 12 <= k * 7 THEN g ELSE r END AS wipe_left, CASE WHEN (2 * (6 - i) + 1) * 12 <= k * 7 THEN g ELSE r END AS wipe_right FROM t""")
def k10_transitions(spark, sf_dir):
    """A dissolve, a dip to black and two wipes of twelve frames."""
    at = lambda kind: pixels.transition(kind, F.col("r"), F.col("g"), F.col("vec_id") % 12, 12, F.col("i"), 7)
    return _rgb(spark, sf_dir).select("vec_id", "i", at("dissolve").alias("dissolve"), at("dip_black").alias("dip"), at("wipe_left").alias("wipe_left"), at("wipe_right").alias("wipe_right"))


@query(f"WITH {_RGB} SELECT vec_id // 30 AS frame, vec_id % 30 // 3 AS x, i // 3 AS y, (sum(r) // count(*))::BIGINT AS r, (sum(g) // count(*))::BIGINT AS g, (sum(b) // count(*))::BIGINT AS b FROM rgb GROUP BY ALL")
def agg18_shrink(spark, sf_dir):
    """Pictures shrunk to a third."""
    own = _rgb(spark, sf_dir).select(F.floor(F.col("vec_id") / 30).alias("frame"), (F.col("vec_id") % 30).alias("x"), F.col("i").alias("y"), "r", "g", "b")
    return pixels.shrunk(own, ["frame"], "x", "y", 3)


@query(f"WITH {_RGB} SELECT vec_id // 5 AS frame, i, ((2 * sum(r) + count(*)) // (2 * count(*)))::BIGINT AS r, ((2 * sum(g) + count(*)) // (2 * count(*)))::BIGINT AS g, ((2 * sum(b) + count(*)) // (2 * count(*)))::BIGINT AS b FROM rgb GROUP BY ALL")
def agg16_average(spark, sf_dir):
    """Five pictures averaged into one."""
    own = _rgb(spark, sf_dir).select(F.floor(F.col("vec_id") / 5).alias("frame"), "i", "r", "g", "b")
    return pixels.averaged(own, ["frame", "i"])


_CURVE = [0, 20, 90, 180, 255]


def _curve_sql(c: str) -> str:
    at = f"least({c} * 4 // 255, 3)"
    return f"(2 * ({_CURVE}[{at} + 1] * (255 - ({c} * 4 - {at} * 255)) + {_CURVE}[{at} + 2] * ({c} * 4 - {at} * 255)) + 255) // 510 AS {c}"


@query(f"WITH {_RGB} SELECT vec_id, i, {', '.join(map(_curve_sql, 'rgb'))} FROM rgb")
def k4_curve(spark, sf_dir):
    """Pixels through a curve of five values."""
    return pixels.looked_up(_rgb(spark, sf_dir), _CURVE)


@query(f"WITH {_RGB} SELECT vec_id, i, CASE WHEN o = 0 THEN 1000 WHEN o >= 30 THEN 0 ELSE (30 - o) * 1000 // 30 END AS weight FROM (SELECT vec_id, i, greatest(100 - g, g - 150, 0) AS o FROM rgb)")
def flt15_band(spark, sf_dir):
    """How far each pixel's green is in a soft band."""
    return _rgb(spark, sf_dir).select("vec_id", "i", pixels.band(F.col("g"), 100, 150, 30).alias("weight"))


@query(f"""WITH RECURSIVE {_SAMPLES}, b AS (SELECT track, k, v, max(0 - k * 20) OVER w + k * 20 AS lo, min(k % 7 * 5 + 400 + k * 20) OVER w - k * 20 AS hi FROM sm WINDOW w AS (PARTITION BY track ORDER BY k DESC ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT track, k, least(greatest(v, lo), hi) AS "at" FROM b WHERE k = 0 UNION ALL SELECT b.track, b.k, least(greatest(b.v, greatest(b.lo, p."at" - 20)), least(b.hi, p."at" + 20)) FROM p JOIN b ON b.track = p.track AND b.k = p.k + 1) SELECT track, k, "at" FROM p""")
def win7_crop_path(spark, sf_dir):
    """A path near the samples that moves at most 20 a step."""
    own = _samples(spark, sf_dir).withColumns({"low": F.lit(0).cast("long"), "high": F.col("k") % 7 * 5 + 400})
    return pixels.crop_path(own, TRACK, "k", "low", "high", "v", 20)


_HSL = f"""{_RGB}, x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
t AS (SELECT *, CASE WHEN hi = r THEN (g - b) * 60000 WHEN hi = g THEN (b - r) * 60000 + 120000 * d ELSE (r - g) * 60000 + 240000 * d END AS t FROM x),
h AS (SELECT vec_id, i, CASE WHEN d > 0 THEN ((2 * ((t % (360000 * d) + 360000 * d) % (360000 * d)) + d) // (2 * d)) % 360000 END AS hue, CASE WHEN d > 0 THEN (2000 * d + 255 - abs(hi + lo - 255)) // (2 * (255 - abs(hi + lo - 255))) ELSE 0 END AS saturation, (2000 * (hi + lo) + 510) // 1020 AS lightness FROM t)"""


@query(f"""WITH {_HSL}, o AS (SELECT *, least(abs(hue - 350000), 360000 - abs(hue - 350000)) AS o, greatest(200 - saturation, saturation - 800, 0) AS p FROM h)
  SELECT vec_id, i, hue, saturation, lightness, round(CASE WHEN o IS NULL OR o >= 90000 THEN 0.0 WHEN o <= 40000 THEN 1.0 ELSE (90000 - o) / 50000 END * CASE WHEN p = 0 THEN 1.0 WHEN p >= 150 THEN 0.0 ELSE (150 - p) / 150 END, 9)::DOUBLE AS weight FROM o""")
def flt15_qualifier(spark, sf_dir):
    """Hue, saturation and lightness, and how far reds of some saturation are selected."""
    own = _rgb(spark, sf_dir).withColumn("c", pixels.hsl(F.col("r"), F.col("g"), F.col("b")))
    weight = pixels.qualified(F.col("c"), (350_000, 40_000, 90_000), (200, 800, 150), None)
    return own.select("vec_id", "i", "c.hue", "c.saturation", "c.lightness", F.round(weight, 9).alias("weight"))


@query(f"WITH {_RGB} SELECT vec_id, i, 255 - r AS r, g, b FROM rgb")
def k4_cube(spark, sf_dir):
    """Pixels through a colour table of 5 ** 3 values that turns red round, read from a .cube text."""
    rows = "\n".join(f"{1 - r / 4} {g / 4} {b / 4}" for b in range(5) for g in range(5) for r in range(5))
    cube = media.parse_cube(spark.createDataFrame([(1, f'TITLE "x"\nLUT_3D_SIZE 5\n{rows}\n')], "id long, text string"), "id", "text")
    return pixels.through_cube(_rgb(spark, sf_dir), cube, 5)


@query(f"WITH {_SAMPLES} SELECT track, k % 2 AS channel, k // 2 AS frame, greatest(-32768, least(32767, v)) AS value FROM sm UNION ALL SELECT track, 1, max(k) // 2, 0 FROM sm GROUP BY track HAVING max(k) % 2 = 0")
def src10_wav(spark, sf_dir):
    """Samples written as stereo WAV files and read again."""
    s = _samples(spark, sf_dir).select("track", (F.col("k") % 2).alias("channel"), F.floor(F.col("k") / 2).alias("frame"), F.col("v").alias("value"))
    pad = s.groupBy("track").agg((F.count_if(F.col("channel") == 0) > F.count_if(F.col("channel") == 1)).alias("odd"), F.max("frame").alias("frame"))
    both = s.unionByName(pad.where("odd").select("track", F.lit(1).alias("channel"), "frame", F.lit(0).alias("value")))
    files = media.encode_wav(both, TRACK, 48_000)
    return media.sound_samples(media.sound_blocks(files, "track", "content"), "track").select("track", F.col("channel").cast("long").alias("channel"), "frame", "value")


def _pass(n: int, last: bool = False) -> str:
    """SQL of one pass over the points p{n}: their lines, and what is near enough for the next."""
    means = f"m{n} AS (SELECT *, sum(w * x) FILTER (i) OVER r / sum(w) FILTER (i) OVER r AS mx, sum(w * y) FILTER (i) OVER r / sum(w) FILTER (i) OVER r AS my, sum(w) FILTER (i) OVER r AS sw, count(*) FILTER (i) OVER r AS n FROM p{n} WINDOW r AS (PARTITION BY track, run)),"
    slopes = f"s{n} AS (SELECT *, CASE WHEN sum(w * (x - mx) * (x - mx)) FILTER (i) OVER t > 0 THEN sum(w * (x - mx) * (y - my)) FILTER (i) OVER t / sum(w * (x - mx) * (x - mx)) FILTER (i) OVER t END AS slope FROM m{n} WINDOW t AS (PARTITION BY track))"
    near = f", n{n} AS (SELECT *, i AND coalesce(abs(y - my - slope * (x - mx)) <= 1.5, true) AS near FROM s{n}), p{n + 1} AS (SELECT track, run, x, y, w, CASE WHEN count(*) FILTER (near) OVER (PARTITION BY track) >= 4 THEN near ELSE i END AS i FROM n{n}),"
    return means + slopes + ("" if last else near)


@query(f"""WITH {_SAMPLES}, p0 AS (SELECT track, k // 20 AS run, k::DOUBLE AS x, (k * 12.5 + v % 3)::DOUBLE AS y, (v % 5 + 1)::DOUBLE AS w, true AS i FROM sm), {_pass(0)} {_pass(1)} {_pass(2, True)},
  b AS (SELECT track, arg_max(slope, (sw, -run)) AS slope, arg_max(my - slope * mx, (sw, -run)) AS intercept FROM s2 WHERE n >= 2 AND i AND slope IS NOT NULL GROUP BY track) SELECT track, round(slope, 6) AS slope, round(intercept, 4) AS intercept FROM b""")
def win10_steady_line(spark, sf_dir):
    """The steady period of each track's events in runs of twenty, outliers dropped."""
    s = _samples(spark, sf_dir)
    points = s.select("track", F.floor(F.col("k") / 20).alias("run"), F.col("k").cast("double").alias("x"), (F.col("k") * 12.5 + F.col("v") % 3).cast("double").alias("y"), (F.col("v") % 5 + 1).cast("double").alias("w"))
    return signals.steady_line(points, TRACK, "run").select("track", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))
