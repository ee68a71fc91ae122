"""Queries of scalar expressions, planes' statistics, gated loudness and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.functions import scalars as sc
from splicework.plans.adapters import read
from splicework.plans.media_queries import _RGB, _rgb
from splicework.plans.queries import _LEVEL, TRACK, _levels, query

_REDUCE = "struct_pack(num := ({n} // gcd({n}, {d}))::BIGINT, den := ({d} // gcd({n}, {d}))::BIGINT)"


def _pair(n: str, d: str) -> str:
    return f"(({n}) // greatest(gcd({n}, {d}), 1))::BIGINT AS num, (({d}) // greatest(gcd({n}, {d}), 1))::BIGINT AS den"


@query(f"""WITH t AS (SELECT o_orderkey AS k, o_custkey AS a, o_orderkey % 997 + 1 AS b FROM orders)
  SELECT k, 'ratio' AS form, {_pair('a', 'b')} FROM t UNION ALL SELECT k, 'decimal', {_pair('a * 1000 + b', '1000')} FROM t UNION ALL SELECT k, 'whole', a, 1 FROM t UNION ALL SELECT k, 'other', NULL, NULL FROM t""")
def s2_literal(spark, sf_dir):
    """Ratios, decimals and whole numbers read exactly; what is none of them is null."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("a"), (F.col("o_orderkey") % 997 + 1).cast("string").alias("b"))
    forms = F.map_from_arrays(F.array(*map(F.lit, ("ratio", "decimal", "whole", "other"))), F.array(F.concat("a", F.lit("/"), "b"), F.concat("a", F.lit("."), F.lpad("b", 3, "0"), F.lit("00")), F.concat(F.lit("0"), "a"), F.concat(F.lit("-"), "a", F.lit("e5"))))
    own = o.select("k", F.explode(forms).alias("form", "text"))
    return own.select("k", "form", sc.literal(F.col("text")).alias("t")).select("k", "form", "t.num", "t.den")


@query(f"""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 50 - 25 AS a, l_suppkey % 12 + 1 AS b, l_quantity::BIGINT AS c, l_partkey % 7 + 1 AS d FROM lineitem)
  SELECT k, i, 'plus' AS op, {_pair('a * d + c * b', 'b * d')} FROM t UNION ALL SELECT k, i, 'minus', {_pair('a * d - c * b', 'b * d')} FROM t UNION ALL SELECT k, i, 'times', {_pair('a * c', 'b * d')} FROM t
  UNION ALL SELECT k, i, 'ticks', CASE WHEN (a * 12) % b = 0 THEN (a * 12) // b END, 12 FROM t""")
def s3_stamps(spark, sf_dir):
    """Signed times added, taken away, multiplied, and in twelfths where they are whole."""
    pair = lambda n, d: F.struct(n.cast("long").alias("num"), d.cast("long").alias("den"))
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), pair(F.col("l_partkey") % 50 - 25, F.col("l_suppkey") % 12 + 1).alias("x"), pair(F.col("l_quantity").cast("long"), F.col("l_partkey") % 7 + 1).alias("y"))
    x, y = F.col("x"), F.col("y")
    each = own.select("k", "i", F.explode(F.create_map(F.lit("plus"), sc.stamp_sum(x, y), F.lit("minus"), sc.stamp_sum(x, y, -1), F.lit("times"), sc.stamp_times(x, y), F.lit("ticks"), F.struct(sc.stamp_ticks(x, 12).alias("num"), F.lit(12).cast("long").alias("den")))).alias("op", "t"))
    return each.select("k", "i", "op", "t.num", "t.den")


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey % 360 AS a, p_size::BIGINT AS b FROM part) SELECT k, CASE WHEN b // gcd(a, b) = 1 THEN (a // gcd(a, b))::VARCHAR ELSE a // gcd(a, b) || '/' || b // gcd(a, b) END AS shown FROM t""")
def s4_display(spark, sf_dir):
    """Times as they are shown, in lowest terms."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), sc.display(F.col("p_partkey") % 360, F.col("p_size").cast("long")).alias("shown"))


@query("""WITH t AS (SELECT event_id AS k, event_id % 4 AS day, event_id % 26 AS h, event_id % 60 AS m, event_id % 61 AS s, event_id % 27 AS f FROM events) SELECT k, CASE WHEN h < 24 AND s < 60 AND f < 25 THEN (day * 86400 + h * 3600 + m * 60 + s) * 25 + f END AS frames FROM t""")
def s7_labels(spark, sf_dir):
    """Clock labels as frames; those out of range as null."""
    n = F.col("event_id")
    text = F.concat_ws(":", *(F.lpad((n % k).cast("string"), 2, "0") for k in (26, 60, 61, 27)))
    return read(spark, sf_dir, "events").select(n.alias("k"), sc.label(n % 4, text).alias("frames"))


@query("""SELECT event_id AS k, least(round((event_id % 5000) * (event_id % 7 * 0.25)), 4000)::INTEGER AS level, round((event_id % 1000) * 0.001::DOUBLE * 100) / 100 AS shown FROM events""")
def s12_levels(spark, sf_dir):
    """Levels scaled and held below the greatest, and values to the hundredth."""
    n = F.col("event_id")
    return read(spark, sf_dir, "events").select(n.alias("k"), sc.scaled_level(n % 5000, n % 7 * 0.25).alias("level"), sc.hundredths(n % 1000 * F.lit(0.001)).alias("shown"))


_PQ, _HLG = sc.PQ, sc.HLG


@query(f"""WITH x AS (SELECT p_partkey AS k, (p_partkey % 256) / 255.0::DOUBLE AS x FROM part)
  SELECT k, round(CASE WHEN x < 0.081 THEN x / 4.5 ELSE pow((x + 0.099) / 1.099, 1 / 0.45) END, 9) AS bt709, round(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END, 9) AS srgb,
  round(pow(greatest(pow(x, 1 / {_PQ[1]}::DOUBLE) - {_PQ[2]}, 0) / ({_PQ[3]} - {_PQ[4]} * pow(x, 1 / {_PQ[1]}::DOUBLE)), 1 / {_PQ[0]}::DOUBLE), 9) AS pq, round(CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - {_HLG[2]}) / {_HLG[0]}) + {_HLG[1]}) / 12 END, 9) AS hlg,
  round(x, 9) AS bt709_again, round(x, 9) AS srgb_again, round(x, 5) AS pq_again, round(x, 5) AS hlg_again FROM x""")
def s15_transfer(spark, sf_dir):
    """Codes as linear light by four curves, and back."""
    x = F.col("x")
    own = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 256 / F.lit(255.0)).alias("x"))
    curves = ("bt709", "srgb", "pq", "hlg")
    own = own.select("k", "x", *(sc.decoded(x, c).alias(c) for c in curves))
    return own.select("k", *(F.round(c, 9).alias(c) for c in curves), *(F.round(sc.encoded(F.col(c), c), 9 if c in ("bt709", "srgb") else 5).alias(f"{c}_again") for c in curves))


@query("""WITH m AS (SELECT vec_id AS k, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS a, list_transform(embedding[2:17], lambda x: x::DOUBLE) AS b FROM embeddings)
  SELECT k, i, round(list_sum(list_transform(range(4), lambda j: a[i // 4 * 4 + j + 1] * b[j * 4 + i % 4 + 1])), 6) AS value FROM m, (SELECT unnest(range(16))::INTEGER AS i)""")
def s16_matrices(spark, sf_dir):
    """Products of 4 x 4 matrices."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    own = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode(sc.product(F.slice(e, 1, 16), F.slice(e, 2, 16))).alias("i", "value"))
    return own.withColumn("value", F.round("value", 6))


@query("""SELECT p_partkey AS k, 'x' AS part, 1.0::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'off', 0.0 FROM part""")
def s16_inverse(spark, sf_dir):
    """A turn and a shift times its inverse: ones on the diagonal and nothing off it."""
    t = F.col("p_partkey") * F.lit(0.1)
    m = F.array(*(c.cast("double") for c in (F.cos(t), -F.sin(t), F.lit(0.0), t, F.sin(t), F.cos(t), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(-3.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    own = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), m.alias("m"))
    p = own.select("k", sc.product(F.col("m"), sc.rigid_inverse(F.col("m"))).alias("p"))
    diagonal = sum((F.get("p", F.lit(5 * i)) for i in range(1, 4)), F.get("p", F.lit(0))) / 4
    off = F.aggregate(F.transform("p", lambda x, i: F.when(i % 5 == 0, 0.0).otherwise(F.abs(x))), F.lit(0.0), lambda a, x: a + x)
    return p.select("k", F.explode(F.create_map(F.lit("x"), F.round(diagonal, 6), F.lit("off"), F.round(F.round(off, 6) + 0.0, 6))).alias("part", "value"))


@query(r"""WITH d AS (SELECT doc_id, substr(text, 1, 40) AS t FROM documents) SELECT doc_id, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug, doc_id % 3 <> 1 AS inside FROM d""")
def s25_slugs(spark, sf_dir):
    """Names made of the start of a text, and paths that lie in a folder."""
    n = F.col("doc_id")
    path = F.when(n % 3 == 0, F.lit("media\\a\\b")).when(n % 3 == 1, F.lit("media/ab")).otherwise(F.lit("media/a"))
    return read(spark, sf_dir, "documents").select("doc_id", sc.slug(F.substring("text", 1, 40)).alias("slug"), sc.within(path, F.lit("media/a/")).alias("inside"))


@query("""WITH s AS (SELECT conv_id, map_from_entries(list((turn, role) ORDER BY turn)) AS m FROM (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role FROM conversations ORDER BY conv_id, turn, role) GROUP BY conv_id) SELECT conv_id, map_keys(m)[1] AS first, map_values(m)[-1] AS last, m[1] AS second FROM s""")
def s30_styles(spark, sf_dir):
    """A map in key order: its first key, its last value, and one looked up."""
    one = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    m = one.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("m"))
    return m.select("conv_id", F.element_at(F.map_keys("m"), 1).alias("first"), F.element_at(F.map_values("m"), -1).alias("last"), F.try_element_at("m", F.lit(1).cast(one.schema["turn"].dataType)).alias("second"))


@query(f"""WITH {_RGB}, p AS (SELECT unnest([('red', r), ('green', g), ('blue', b), ('luma', (2126 * r + 7152 * g + 722 * b + 5000) // 10000)]) AS p FROM rgb), v AS (SELECT p[1] AS plane, p[2] AS value FROM p)
  SELECT plane, min(value)::BIGINT AS least, max(value)::BIGINT AS most, sum(value)::BIGINT AS total, count(*) AS n FROM v GROUP BY plane""")
def agg1_planes(spark, sf_dir):
    """Least, greatest and total of each plane, luma among them."""
    luma = F.floor((F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722 + 5000) / 10000)
    planes = F.create_map(F.lit("red"), F.col("r").cast("long"), F.lit("green"), F.col("g").cast("long"), F.lit("blue"), F.col("b").cast("long"), F.lit("luma"), luma.cast("long"))
    own = _rgb(spark, sf_dir).select(F.explode(planes).alias("plane", "value"))
    return own.groupBy("plane").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"), F.count("*").alias("n"))


@query(f"""WITH {_LEVEL}, e AS (SELECT track, id, pow(10, db / 1000.0::DOUBLE) AS e FROM lv), b AS (SELECT track, avg(e) OVER w AS e, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY track ORDER BY id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
  g AS (SELECT track, e FROM b WHERE n = 4 AND e > 2), r AS (SELECT track, avg(e) * 0.1 AS gate FROM g GROUP BY track) SELECT track, count(*) AS blocks, round(-0.691 + 10 * log10(avg(e)), 6) AS loudness FROM g JOIN r USING (track) WHERE e > gate GROUP BY track""")
def agg7_loudness(spark, sf_dir):
    """Loudness of blocks of four steps, one step apart, past an absolute and a relative gate."""
    own = _levels(spark, sf_dir).select("track", "id", F.pow(F.lit(10.0), F.col("db") / 1000.0).alias("e"))
    w = W.Window.partitionBy("track").orderBy("id").rowsBetween(-3, 0)
    blocks = own.select("track", F.avg("e").over(w).alias("e"), F.count("*").over(w).alias("n")).where("n = 4 AND e > 2").drop("n")
    gate = blocks.groupBy("track").agg((F.avg("e") * 0.1).alias("gate"))
    kept = blocks.join(gate, TRACK).where("e > gate")
    return kept.groupBy("track").agg(F.count("*").alias("blocks"), F.round(F.log10(F.avg("e")) * 10 - 0.691, 6).alias("loudness"))
