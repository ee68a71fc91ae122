"""Queries of edits, curves and cut lists over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from splicework.operators import edits
from splicework.operators import intervals as iv
from splicework.plans.adapters import CLIPS, WIDTH, clips, read
from splicework.plans.queries import _MERGED, _PIECES, _SEQ, HOUR, TRACK, _cuts, _placed, query

PLACED = ["track", "id", "start", "stop", "source_in"]
MODES = ("hold", "linear", "ease_in", "ease_out", "ease_in_out")


@query(f"WITH {CLIPS} SELECT track, id, start, stop, source_in + CASE WHEN id % 7 = 0 THEN 40 ELSE 0 END AS source_in FROM clips")
def int9_slip(spark, sf_dir):
    """Every seventh clip slipped by 40 ticks."""
    return edits.slipped(clips(spark, sf_dir), F.col("id") % 7 == 0, 40).select(*PLACED)


@query(f"""WITH {_SEQ}, m AS (SELECT *, coalesce(id = 2 AND lag(stop) OVER w = start AND lead(start) OVER w = stop, false) AS mid FROM pl WINDOW w AS (PARTITION BY track ORDER BY start)),
  n AS (SELECT *, coalesce(lead(mid) OVER w, false) AS l, coalesce(lag(mid) OVER w, false) AS r FROM m WINDOW w AS (PARTITION BY track ORDER BY start))
  SELECT track, id, start + (mid OR r)::INT AS start, stop + (mid OR l)::INT AS stop, source_in + r::INT AS source_in FROM n""")
def int11_slide(spark, sf_dir):
    """Each track's second clip slid by a tick between its neighbours."""
    return edits.slid(_placed(spark, sf_dir), TRACK, F.lit(2), 1)


@query(_PIECES + " SELECT * FROM pieces UNION ALL SELECT track, NULL, start, stop, 0 FROM u")
def int13_overwrite(spark, sf_dir):
    """Stretches overwritten by new material, the rest left in place."""
    c = clips(spark, sf_dir)
    new = iv.merged(_cuts(c), TRACK).select("track", F.lit(None).cast("long").alias("id"), "start", "stop", F.lit(0).cast("long").alias("source_in"))
    return edits.overwritten(c, new, TRACK, WIDTH).select(*PLACED)


@query(f"""WITH {CLIPS}, n AS (SELECT * FROM clips WHERE id % 12 = 1) SELECT track, id, start, stop, source_in FROM n
  UNION ALL SELECT track, id, start, stop, source_in FROM clips c WHERE id % 12 <> 1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.track = c.track AND n.start < c.stop AND c.start < n.stop)""")
def int17_place(spark, sf_dir):
    """Clips placed over others, which go where they collide."""
    c = clips(spark, sf_dir).select(*PLACED)
    return edits.placed_over(c.where("id % 12 <> 1"), c.where("id % 12 = 1"), TRACK, WIDTH)


@query(f"""WITH {_SEQ}, r AS (SELECT track, id, row_number() OVER (PARTITION BY track ORDER BY id) AS r, count(*) OVER (PARTITION BY track) AS n, max(CASE WHEN id = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track) AS h FROM pl)
  SELECT track, id, CASE WHEN h = 0 THEN r WHEN id = 1 THEN least(3, n) WHEN r - 1 >= least(3, n) THEN r ELSE r - 1 END AS place FROM r""")
def int8_move(spark, sf_dir):
    """Each track's first clip moved to the third place."""
    return edits.moved(_placed(spark, sf_dir).select("track", "id"), TRACK, "id", F.col("id") == 1, 3)


@query(f"WITH {_SEQ} SELECT track, start, stop, CASE WHEN stop - start >= 2 THEN 2 ELSE 1 END::BIGINT AS members FROM pl")
def int23_continuous(spark, sf_dir):
    """Clips split in their middles are continuous again over each split, and over it alone."""
    halves = iv.split_at(_placed(spark, sf_dir), F.floor((F.col("start") + F.col("stop")) / 2))
    return edits.continuous(halves, TRACK, "id")


@query(f"""WITH {CLIPS}, e AS (SELECT track, min(start) AS a, max(stop) AS b FROM clips GROUP BY track),
  ts AS (SELECT x.track, t FROM (SELECT track, start AS t FROM clips UNION SELECT track, stop FROM clips) x JOIN e ON e.track = x.track AND t > a AND t < b),
  v AS (SELECT q.track, q.t, arg_max(c.id, c.layer * 1000000000 - c.id) AS id FROM (SELECT track, t FROM ts UNION SELECT track, t - 1 FROM ts) q JOIN clips c ON c.track = q.track AND c.start <= q.t AND q.t < c.stop GROUP BY ALL),
  p AS (SELECT v.track, v.t, v.id, c.asset, c.source_in - c.start AS o FROM v JOIN clips c ON c.track = v.track AND c.id = v.id)
  SELECT ts.track, ts.t AS at, a.id AS before, b.id AS after, coalesce(a.asset = b.asset AND a.o = b.o, false) AS continuous
  FROM ts LEFT JOIN p a ON a.track = ts.track AND a.t = ts.t - 1 LEFT JOIN p b ON b.track = ts.track AND b.t = ts.t WHERE a.id IS DISTINCT FROM b.id""")
def int33_cut_list(spark, sf_dir):
    """Times where the visible clip of a track changes."""
    return edits.cut_list(clips(spark, sf_dir), TRACK, "asset", WIDTH)


@query(f"""WITH {CLIPS}, k0 AS (SELECT track, start AS ka, max((id % 1000 - 500, id % 5)) AS k FROM clips WHERE layer = 2 GROUP BY ALL),
  k AS (SELECT track, ka, k[1]::HUGEINT AS a, k[2] AS m, lead(ka) OVER w AS z, (lead(k[1]) OVER w)::HUGEINT AS b, first_value(k[1]) OVER w AS f FROM k0 WINDOW w AS (PARTITION BY track ORDER BY ka)),
  f AS (SELECT DISTINCT track, f FROM k), j AS (SELECT c.track, c.id, c.start, k.* EXCLUDE (track, f), f.f FROM clips c ASOF LEFT JOIN k ON c.track = k.track AND c.start >= k.ka LEFT JOIN f ON f.track = c.track),
  n AS (SELECT *, (start - ka)::HUGEINT AS n, (z - ka)::HUGEINT AS d FROM j),
  t AS (SELECT *, d * d AS q, CASE m WHEN 1 THEN n * d WHEN 2 THEN n * n WHEN 3 THEN d * d - (d - n) * (d - n) WHEN 4 THEN CASE WHEN 2 * n <= d THEN 2 * n * n ELSE d * d - 2 * (d - n) * (d - n) END END AS p FROM n),
  v AS (SELECT *, a * (q - p) + b * p AS s FROM t)
  SELECT track, id, (CASE WHEN ka IS NULL THEN f WHEN z IS NULL OR m = 0 THEN a WHEN s < 0 THEN -((2 * -s + q) // (2 * q)) ELSE (2 * s + q) // (2 * q) END)::BIGINT AS value FROM v""")
def jn7_curve(spark, sf_dir):
    """A keyed curve's value at each clip's start, eased and rounded once."""
    c = clips(spark, sf_dir)
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("id") % 5 + 1).cast("int"))
    # keys of one time: the greatest value counts; equal values have equal ids modulo 5 and so one mode
    curve = c.where("layer = 2").select("track", F.col("start").alias("at"), (F.col("id") % 1000 - 500).alias("value"), mode.alias("mode"))
    return edits.sampled(c.select("track", "id", F.col("start").alias("at")), curve, TRACK).select("track", "id", "value")


@query(f"WITH {CLIPS} SELECT track, id, i::INT AS index, start * 8 + (i * 2 + 1) * (stop - start) AS num, 8 AS den FROM (SELECT *, unnest(range(4)) AS i FROM clips)")
def win25_spread(spark, sf_dir):
    """Four evenly spread times of each clip, exactly."""
    return edits.spread(clips(spark, sf_dir), 4).select("track", "id", "index", "num", "den")


@query(f"""WITH {CLIPS}, sp AS (SELECT * FROM clips WHERE layer = 0), r AS (SELECT min(start) AS a, max(stop) AS b FROM clips), {_MERGED.format(rows='sp', test='>= 180')},
  p AS (SELECT track, lag(stop) OVER (PARTITION BY track ORDER BY start) AS start, start AS stop, 'between' AS kind FROM u
    UNION ALL SELECT track, a, min(start), 'leading' FROM u, r GROUP BY track, a HAVING min(start) - a >= 180 UNION ALL SELECT track, max(stop), b, 'trailing' FROM u, r GROUP BY track, b HAVING b - max(stop) >= 180),
  q AS (SELECT *, ceil((start + CASE kind WHEN 'leading' THEN 0 ELSE 10 END) / 12)::BIGINT * 12 AS x, floor((stop - CASE kind WHEN 'trailing' THEN 0 ELSE 10 END) / 12)::BIGINT * 12 AS y FROM p WHERE start IS NOT NULL)
  SELECT track, start, stop, kind, CASE WHEN x < y THEN x END AS cut_start, CASE WHEN x < y THEN y END AS cut_stop FROM q""")
def int27_pauses(spark, sf_dir):
    """Pauses of an hour or more, and what of them to cut."""
    c = clips(spark, sf_dir)
    a, b = c.agg(F.min("start"), F.max("stop")).first()
    return edits.pauses(c.where("layer = 0"), TRACK, F.lit(a), F.lit(b), HOUR, 10, 12, HOUR)


@query(f"WITH {_SEQ} SELECT track, id, start, stop, source_in, kind, track || '-' || id AS link FROM pl, (VALUES ('video'), ('audio')) k(kind)")
def int20_promote(spark, sf_dir):
    """Sequential clips on a picture and a sound track, linked."""
    return edits.promoted(_placed(spark, sf_dir), TRACK)


@query(f"""WITH {CLIPS}, g AS (SELECT id, start - max(stop) OVER (PARTITION BY track ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM clips)
  SELECT 'black' AS issue, id AS subject, n FROM g WHERE n > 0 UNION ALL SELECT 'flash_frame', id, stop - start FROM clips WHERE stop - start < 520
  UNION ALL SELECT 'missing_media', asset, count(*) FROM clips WHERE asset NOT IN (SELECT doc_id FROM documents) GROUP BY asset
  UNION ALL SELECT 'unused_asset', doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT asset FROM clips)""")
def int39_lint(spark, sf_dir):
    """Black stretches, flash frames, missing media and unused assets."""
    return edits.lint(clips(spark, sf_dir), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset")), TRACK, "asset", 520)
