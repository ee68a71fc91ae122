"""The library's queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicework.functions import rational
from splicework.operators import intervals as iv
from splicework.operators import ordered, snapshots
from splicework.plans.adapters import CLIPS, WIDTH, WORDS, clips, read, words
from splicework.sources import captions

QUERIES, ORACLES = {}, {}
TRACK = ["track"]
CUTS = "cuts AS (SELECT track, start + 200 AS start, start + 500 AS stop FROM clips WHERE id % 3 = 0)"
DAY, HOUR = 4_320, 180  # ticks


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _cuts(c: DataFrame) -> DataFrame:
    return c.where("id % 3 = 0").select("track", (F.col("start") + 200).alias("start"), (F.col("start") + 500).alias("stop"))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"""WITH {CLIPS}, {WORDS} SELECT c.track, c.id AS clip, w.asset, w.pos::BIGINT AS pos, w.word, c.start + w.start - c.source_in AS at,
  CASE WHEN w.start < c.source_in THEN 'start_cut' WHEN w.stop > c.source_in + c.stop - c.start THEN 'end_cut' ELSE 'said' END AS kind
  FROM clips c JOIN words w ON w.asset = c.asset AND w.start < c.source_in + c.stop - c.start AND c.source_in < w.stop""")
def jn2_timeline_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a timeline says: words of each clip's source range, shifted to the timeline; words across an edge are cut."""
    c = clips(spark, sf_dir).select("track", F.col("id").alias("clip"), "asset", F.col("start").alias("place"), F.col("source_in").alias("start"), (F.col("source_in") + F.col("stop") - F.col("start")).alias("stop"))
    hit = iv.overlap_join(c, words(spark, sf_dir, c), ["asset"], WIDTH)
    kind = F.when(F.col("other_start") < F.col("start"), "start_cut").when(F.col("other_stop") > F.col("stop"), "end_cut").otherwise("said")
    return hit.select("track", "clip", "asset", F.col("pos").cast("long").alias("pos"), "word", (F.col("place") + F.col("other_start") - F.col("start")).alias("at"), kind.alias("kind"))


@query(f"""WITH {CLIPS}, r AS (SELECT min(start) AS a FROM clips) SELECT track, id, greatest(start, a + {DAY}) AS start, least(stop, a + 2 * {DAY}) AS stop,
  source_in + greatest(start, a + {DAY}) - start AS source_in FROM clips, r WHERE start < a + 2 * {DAY} AND a + {DAY} < stop""")
def flt4_slice(spark, sf_dir):
    """Timeline slice: one day of clips."""
    c = clips(spark, sf_dir)
    a = c.agg(F.min("start")).first()[0]
    return iv.sliced(c, F.lit(a + DAY), F.lit(a + 2 * DAY)).select("track", "id", "start", "stop", "source_in")


_MERGED = """m AS (SELECT track, start, stop, max(stop) OVER (PARTITION BY track ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {rows}),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach {test} THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT track, min(start) AS start, max(stop) AS stop, count(*) AS members FROM g GROUP BY track, g)"""


@query(f"WITH {CLIPS}, {_MERGED.format(rows='clips', test='> 0')} SELECT * FROM u")
def int2_merge(spark, sf_dir):
    """Touching and overlapping clips of a track merged."""
    return iv.merged(clips(spark, sf_dir), TRACK)


@query(f"WITH {CLIPS}, {_MERGED.format(rows='clips', test='>= 180')} SELECT * FROM u")
def int3_bridge(spark, sf_dir):
    """Merged with gaps below an hour bridged."""
    return iv.merged(clips(spark, sf_dir), TRACK, HOUR)


@query(f"""WITH {CLIPS}, r AS (SELECT min(start) AS a, max(stop) AS b FROM clips), {_MERGED.format(rows='clips', test='> 0')},
  h AS (SELECT track, coalesce(lag(stop) OVER (PARTITION BY track ORDER BY start), (SELECT a FROM r)) AS start, start AS stop FROM u
  UNION ALL SELECT track, max(stop), (SELECT b FROM r) FROM u GROUP BY track) SELECT * FROM h WHERE start < stop""")
def int1_holes(spark, sf_dir):
    """What of the whole timeline each track leaves uncovered."""
    c = clips(spark, sf_dir)
    a, b = c.agg(F.min("start"), F.max("stop")).first()
    return iv.holes(c, TRACK, F.lit(a), F.lit(b))


_PIECES = f"""WITH {CLIPS}, {CUTS}, {_MERGED.format(rows='cuts', test='> 0')},
edge AS (SELECT c.track, id, c.start AS s, source_in, c.start AS a, c.stop AS z FROM clips c),
hit AS (SELECT e.*, u.start AS cs, u.stop AS ce FROM edge e JOIN u ON u.track = e.track AND u.start < e.z AND e.s < u.stop),
p AS (SELECT track, id, source_in, s, coalesce(lag(ce) OVER (PARTITION BY track, id ORDER BY cs), s) AS start, cs AS stop FROM hit
  UNION ALL SELECT track, id, source_in, s, max(ce), max(z) FROM hit GROUP BY ALL
  UNION ALL SELECT track, id, source_in, s, s, z FROM edge e WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.track = e.track AND hit.id = e.id)),
pieces AS (SELECT track, id, start, stop, source_in + start - s AS source_in FROM p WHERE start < stop)"""


@query(_PIECES + " SELECT * FROM pieces")
def int5_subtract(spark, sf_dir):
    """The pieces of clips that cuts leave."""
    c = clips(spark, sf_dir)
    return iv.subtracted(c, _cuts(c), TRACK, WIDTH).select("track", "id", "start", "stop", "source_in")


@query(_PIECES + """, t AS (SELECT p.*, coalesce((SELECT sum(u.stop - u.start) FROM u WHERE u.track = p.track AND u.stop <= p.start), 0)::BIGINT AS gone FROM pieces p)
  SELECT track, id, start - gone AS start, stop - gone AS stop, source_in FROM t""")
def int14_ripple(spark, sf_dir):
    """Ripple delete: cuts taken out and closed."""
    c = clips(spark, sf_dir)
    return iv.rippled(c.select("track", "id", "start", "stop", "source_in"), _cuts(c), TRACK, WIDTH).select("track", "id", "start", "stop", "source_in")


_SPLIT = f"""WITH {CLIPS}, r AS (SELECT (min(start) + max(stop)) // 2 AS t FROM clips),
sp AS (SELECT track, id, start, CASE WHEN start < t AND t < stop THEN t ELSE stop END AS stop, source_in, 0 AS part FROM clips, r
  UNION ALL SELECT track, id, t, stop, source_in + t - start, 1 FROM clips, r WHERE start < t AND t < stop)"""


def _middle(c: DataFrame) -> int:
    a, b = c.agg(F.min("start"), F.max("stop")).first()
    return (a + b) // 2


@query(_SPLIT + " SELECT * FROM sp")
def int6_split(spark, sf_dir):
    """All clips split at one time."""
    c = clips(spark, sf_dir)
    return iv.split_at(c, F.lit(_middle(c))).select("track", "id", "start", "stop", "source_in", "part")


@query(_SPLIT + " SELECT track, id, start + CASE WHEN start >= t THEN 250 ELSE 0 END AS start, stop + CASE WHEN start >= t THEN 250 ELSE 0 END AS stop, source_in, part FROM sp, r")
def int12_insert(spark, sf_dir):
    """250 ticks of room inserted."""
    c = clips(spark, sf_dir)
    return iv.inserted(c, F.lit(_middle(c)), 250).select("track", "id", "start", "stop", "source_in", "part")


_SEQ = """seq AS (SELECT l_orderkey AS track, l_linenumber::BIGINT AS id, sum(l_quantity::BIGINT)::BIGINT AS n, min(l_partkey) AS source_in,
  sum(sum(l_quantity::BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS stop FROM lineitem GROUP BY l_orderkey, l_linenumber),
pl AS (SELECT track, id, stop - n AS start, stop, source_in FROM seq)"""


def _placed(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("id"))
    lines = lines.agg(F.sum(F.col("l_quantity").cast("long")).alias("n"), F.min("l_partkey").alias("source_in"))
    return iv.placed(lines, TRACK, "id", "n").select("track", "id", "start", "stop", "source_in")


@query(f"WITH {_SEQ} SELECT * FROM pl")
def win1_positions(spark, sf_dir):
    """Sequential clips placed by the running sum of their lengths."""
    return _placed(spark, sf_dir)


@query(f"""WITH {_SEQ}, t AS (SELECT *, id = 2 AND lead(start) OVER w = stop AS l, coalesce(lag(id) OVER w, 0) = 2 AS r FROM pl WINDOW w AS (PARTITION BY track ORDER BY start))
  SELECT track, id, start + CASE WHEN r THEN 1 ELSE 0 END AS start, stop + CASE WHEN l THEN 1 ELSE 0 END AS stop, source_in + CASE WHEN r THEN 1 ELSE 0 END AS source_in FROM t""")
def int10_roll(spark, sf_dir):
    """The cut behind each track's second clip moved by a tick."""
    return iv.rolled(_placed(spark, sf_dir), TRACK, F.lit(2), 1)


@query(f"""WITH {CLIPS}, e AS (SELECT track, start AS t, 1 AS d FROM clips UNION ALL SELECT track, stop, -1 FROM clips),
  r AS (SELECT track, sum(d) OVER (PARTITION BY track ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT track, max(k)::BIGINT AS most FROM r GROUP BY track""")
def flt10_most_at_once(spark, sf_dir):
    """The greatest number of clips of a track that hold at once, by a sweep."""
    return iv.most_at_once(clips(spark, sf_dir), TRACK)


@query(f"""WITH {CLIPS}, b AS (SELECT track, start AS t FROM clips UNION SELECT track, stop FROM clips),
  c AS (SELECT track, t AS start, lead(t) OVER (PARTITION BY track ORDER BY t) AS stop FROM b)
  SELECT c.track, c.start, c.stop, count(*) AS layers FROM c JOIN clips k ON k.track = c.track AND k.start < c.stop AND c.start < k.stop GROUP BY ALL""")
def int34_segments(spark, sf_dir):
    """Elementary intervals between all boundaries, with their layers."""
    return iv.segments(clips(spark, sf_dir), TRACK, WIDTH)


@query(f"""WITH {CLIPS}, p AS (SELECT DISTINCT track, start + 300 AS t FROM clips)
  SELECT p.track, p.t AS at, arg_max(c.id, c.layer * 1000000000 - c.id) AS id FROM p JOIN clips c ON c.track = p.track AND c.start <= p.t AND p.t < c.stop GROUP BY ALL""")
def jn6_visible(spark, sf_dir):
    """The topmost clip at given times."""
    c = clips(spark, sf_dir)
    return iv.visible(c.select("track", (F.col("start") + 300).alias("at")).distinct(), c, TRACK, WIDTH)


@query(f"WITH {CLIPS} SELECT a.track, a.id, b.id AS other_id FROM clips a JOIN clips b ON a.track = b.track AND a.id < b.id AND a.start < b.stop AND b.start < a.stop")
def jn4_collisions(spark, sf_dir):
    """Clips of a track that overlap."""
    return iv.collisions(clips(spark, sf_dir), TRACK, WIDTH)


@query(f"""WITH {CLIPS}, p AS (SELECT DISTINCT track, start AS t FROM clips WHERE layer = 0), q AS (SELECT DISTINCT track, start AS mark FROM clips WHERE layer = 1)
  SELECT q.track, q.mark, arg_min(t, abs(t - mark) * 2 + CASE WHEN t > mark THEN 1 ELSE 0 END) AS at FROM q JOIN p ON p.track = q.track AND abs(t - mark) <= 180 GROUP BY ALL""")
def jn10_nearest(spark, sf_dir):
    """For each mark, the nearest onset within an hour, the earlier on ties."""
    c = clips(spark, sf_dir)
    return iv.nearest(c.where("layer = 0").select("track", F.col("start").alias("at")).distinct(), c.where("layer = 1").select("track", F.col("start").alias("mark")).distinct(), TRACK, HOUR)


@query(f"""WITH {CLIPS}, k AS (SELECT track, start AS at, max(id) AS key_id FROM clips WHERE layer = 2 GROUP BY ALL)
  SELECT c.track, c.id, k.key_id FROM clips c ASOF LEFT JOIN k ON c.track = k.track AND c.start >= k.at""")
def jn7_as_of(spark, sf_dir):
    """The last key at or before each clip's start."""
    c = clips(spark, sf_dir)
    keys = c.where("layer = 2").groupBy("track", F.col("start").alias("at")).agg(F.max("id").alias("key_id"))
    return iv.as_of(c.select("track", "id", F.col("start").alias("at")), keys, TRACK, "key_id").select("track", "id", "key_id")


_LEVEL = "lv AS (SELECT user_id AS track, event_id AS id, round(value * 100)::BIGINT AS db FROM events)"


def _levels(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("db"))


@query(f"""WITH {_LEVEL} SELECT track, id, db, greatest(coalesce(CASE WHEN lag(db) OVER w IS NULL THEN NULL WHEN lag(db, 2) OVER w IS NULL THEN db - lag(db) OVER w
  ELSE least(db - lag(db) OVER w, db - lag(db, 2) OVER w + 3) END, 0), 0) AS rise FROM lv WINDOW w AS (PARTITION BY track ORDER BY id)""")
def win3_onset_rise(spark, sf_dir):
    """Onset strength of a level series."""
    return ordered.onset_rise(_levels(spark, sf_dir), TRACK, "id", "db")


@query(f"""WITH {_LEVEL}, t AS (SELECT track, id, db, coalesce(lag(db, 2) OVER w, 0) + 2 * coalesce(lag(db) OVER w, 0) + 3 * db + 2 * coalesce(lead(db) OVER w, 0) + coalesce(lead(db, 2) OVER w, 0) AS s,
  3 + CASE WHEN lag(db) OVER w IS NULL THEN 0 ELSE 2 END + CASE WHEN lag(db, 2) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(db) OVER w IS NULL THEN 0 ELSE 2 END + CASE WHEN lead(db, 2) OVER w IS NULL THEN 0 ELSE 1 END AS k
  FROM lv WINDOW w AS (PARTITION BY track ORDER BY id)) SELECT track, id, db, (sign(s) * ((abs(s) * 2 + k) // (k * 2)))::BIGINT AS smooth FROM t""")
def win6_triangular(spark, sf_dir):
    """Triangular smoothing of radius 2."""
    return ordered.triangular(_levels(spark, sf_dir), TRACK, "id", "db", 2)


@query(f"""WITH {_LEVEL}, l AS (SELECT track, db::DOUBLE AS e FROM lv WHERE db > 100), g AS (SELECT track, avg(e) * 0.5 AS g FROM l GROUP BY track)
  SELECT track, count(*) AS blocks, round(avg(e), 6) AS gated FROM l JOIN g USING (track) WHERE e > g GROUP BY track""")
def agg7_gated_mean(spark, sf_dir):
    """Two-pass gated mean: an absolute floor, then one relative to the first mean."""
    return ordered.gated_mean(_levels(spark, sf_dir).withColumn("e", F.col("db").cast("double")), TRACK, "e", 100.0, 0.5).withColumn("gated", F.round("gated", 6))


@query(f"""WITH {_LEVEL}, v AS (SELECT track, id, db >= 500 AS value FROM lv), n AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER (PARTITION BY track ORDER BY id) AND row_number() OVER (PARTITION BY track ORDER BY id) > 1 THEN 0 ELSE 1 END AS b FROM v),
  r AS (SELECT *, sum(b) OVER (PARTITION BY track ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT track, run, value, min(id) AS first, count(*) AS length FROM r GROUP BY ALL""")
def agg9_runs(spark, sf_dir):
    """Runs of loud and quiet samples."""
    return ordered.runs(_levels(spark, sf_dir), TRACK, "id", F.col("db") >= 500)


@query(f"""WITH RECURSIVE {CLIPS}, c AS (SELECT DISTINCT track, start FROM clips), t AS (SELECT track, min(start) AS start FROM c GROUP BY track
  UNION ALL SELECT track, n FROM (SELECT t.track, min(c.start) AS n FROM t JOIN c ON c.track = t.track AND c.start >= t.start + {HOUR} GROUP BY t.track)) SELECT * FROM t""")
def win4_spaced(spark, sf_dir):
    """Greedy minimum spacing of clip starts: an hour."""
    return ordered.spaced(clips(spark, sf_dir).select("track", "start"), TRACK, "start", HOUR)


@query(f"""WITH {CLIPS}, w AS (SELECT track, id, sum(stop - start) OVER o AS b, count(*) OVER o AS n FROM clips WINDOW o AS (PARTITION BY track ORDER BY start DESC, id DESC ROWS UNBOUNDED PRECEDING))
  SELECT track, id AS key FROM w WHERE b > 8000 OR n > 6""")
def win22_evicted(spark, sf_dir):
    """Least-recent eviction of a cache to a budget of bytes and of entries."""
    c = clips(spark, sf_dir).select("track", F.col("id").alias("key"), F.col("start").alias("touched"), (F.col("stop") - F.col("start")).alias("bytes"))
    return ordered.evicted(c, TRACK, 8_000, 6).select("track", "key")


@query(f"WITH {CLIPS} SELECT track, start // 30 AS window, count(*) AS n, round(sum(value * value), 4) AS power FROM clips GROUP BY ALL")
def win2_tumbling_power(spark, sf_dir):
    """Power per fixed ten-minute window."""
    c = clips(spark, sf_dir)
    return c.groupBy("track", F.floor(F.col("start") / 30).alias("window")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("power"))


_PIX = """px AS (SELECT vec_id, (i - 1) % 3 AS channel, greatest(0, least(255, floor(embedding[i]::DOUBLE * 64 + 128)))::BIGINT AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def _pixels(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", (F.col("i") % 3).cast("long").alias("channel"), F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("x").cast("double") * 64 + 128))).cast("long").alias("value"))


@query(f"WITH {_PIX} SELECT channel, value, count(*) AS n FROM px GROUP BY ALL")
def agg1_histogram(spark, sf_dir):
    """256-bin histograms per channel."""
    return ordered.histogram(_pixels(spark, sf_dir), ["channel"], "value")


@query(f"WITH {_PIX} SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM px GROUP BY channel")
def agg4_mean_deviation(spark, sf_dir):
    """Mean and population deviation, from the histogram."""
    h, v, n = ordered.histogram(_pixels(spark, sf_dir), ["channel"], "value"), F.col("value").cast("double"), F.col("n")
    s = h.groupBy("channel").agg(F.sum(n).alias("k"), F.sum(v * n).alias("a"), F.sum(v * v * n).alias("b"))
    mean = F.col("a") / F.col("k")
    return s.select("channel", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.col("b") / F.col("k") - mean * mean), 6).alias("deviation"))


@query(f"""WITH {_PIX}, s AS (SELECT channel, value, count(*) AS n FROM px WHERE vec_id % 2 = 0 GROUP BY ALL), r AS (SELECT channel, value, count(*) AS n FROM px WHERE vec_id % 2 = 1 GROUP BY ALL),
  sc AS (SELECT channel, value, sum(n) OVER (PARTITION BY channel ORDER BY value) AS c, sum(n) OVER (PARTITION BY channel) AS k FROM s),
  rc AS (SELECT channel, value, sum(n) OVER (PARTITION BY channel ORDER BY value) AS c, sum(n) OVER (PARTITION BY channel) AS k FROM r)
  SELECT sc.channel, sc.value, min(rc.value) AS matched FROM sc JOIN rc ON rc.channel = sc.channel AND rc.c * sc.k >= sc.c * rc.k GROUP BY ALL""")
def agg5_cdf_match(spark, sf_dir):
    """Histogram matching: even vectors' values mapped to odd ones'."""
    p = _pixels(spark, sf_dir)
    return ordered.cdf_match(*(ordered.histogram(p.where(F.col("vec_id") % 2 == k), ["channel"], "value") for k in (0, 1)), ["channel"])


@query("""SELECT p_partkey AS id, p_name AS title FROM part WHERE split_part(p_type, ' ', 1) = 'STANDARD'
  AND (contains(lower(p_name), 'a') OR contains(p_partkey::VARCHAR, 'a') OR contains(lower(p_type), 'a') OR contains(lower(p_brand), 'a'))""")
def flt1_search(spark, sf_dir):
    """Registry search by bin and text."""
    a = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.split("p_type", " ").alias("bin"), F.array("p_brand").alias("tags"))
    return snapshots.search(a, ["STANDARD"], [], "A").select("id", "title")


@query("SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS bytes, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def flt2_duplicates(spark, sf_dir):
    """Contents that several documents share."""
    return snapshots.duplicates(read(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
  s AS (SELECT o_custkey AS project, r AS revision, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS quantity FROM o JOIN lineitem ON l_orderkey = o_orderkey),
  a AS (SELECT project, revision + 1 AS revision, line, quantity FROM s JOIN (SELECT o_custkey AS project, max(r) AS top FROM o GROUP BY 1) USING (project) WHERE revision < top),
  b AS (SELECT * FROM s WHERE revision > 1)
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.revision, b.revision) AS revision, coalesce(a.line, b.line) AS line,
  CASE WHEN a.project IS NULL THEN 'added' WHEN b.project IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.project = b.project AND a.revision = b.revision AND a.line = b.line WHERE a.quantity IS DISTINCT FROM b.quantity""")
def jn19_changes(spark, sf_dir):
    """Semantic difference of each revision from the one before, by line."""
    o = snapshots.numbered(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("quantity"))
    s = o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_custkey").alias("project"), F.col("revision").cast("long").alias("revision"), "line", "quantity")
    top = o.groupBy(F.col("o_custkey").alias("project")).agg(F.max("revision").alias("top"))
    old = s.join(top, "project").where("revision < top").withColumn("revision", F.col("revision") + 1)
    return snapshots.changes(old, s.where("revision > 1"), ["project", "revision", "line"], ["quantity"])


@query("""WITH o AS (SELECT o_custkey AS project, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders),
  h AS (SELECT *, row_number() OVER w AS place, lead(revision) OVER w AS parent FROM o WHERE revision < 8 WINDOW w AS (PARTITION BY project ORDER BY revision DESC))
  SELECT project, o_orderkey, revision, parent, place = 3 AND parent IS NOT NULL AS more FROM h WHERE place <= 3""")
def win20_history(spark, sf_dir):
    """A page of three revisions before the eighth, the newest first."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey", "o_orderdate")
    h = snapshots.history(snapshots.numbered(o, "project", "o_orderdate", "o_orderkey"), "project", F.lit(8), 3)
    return _long(h.select("project", "o_orderkey", "revision", "parent", "more"), "revision", "parent")


_EDGES = """e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT parent, child, 1 AS depth FROM e UNION SELECT t.parent, e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.child WHERE t.depth < 8)
  SELECT parent, child, min(depth)::INTEGER AS depth FROM t GROUP BY ALL""")
def jn15_descendants(spark, sf_dir):
    """Transitive dependents, up to eight deep."""

    def edges(name: str, up: str, a: str, down: str, b: str) -> DataFrame:
        return read(spark, sf_dir, name).select(F.concat(F.lit(up), F.col(a).cast("string")).alias("parent"), F.concat(F.lit(down), F.col(b).cast("string")).alias("child"))

    e = edges("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edges("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(edges("supplier", "n", "s_nationkey", "s", "s_suppkey"))
    return snapshots.descendants(e, 8)


@query("""SELECT event_id, (event_id + 1) // gcd(event_id + 1, 24000) AS num, 24000 // gcd(event_id + 1, 24000) AS den,
  CASE WHEN (event_id + 1) * 48000 % 24000 = 0 THEN (event_id + 1) * 2 END AS samples, CASE WHEN (event_id + 1) * 25 % 24000 = 0 THEN (event_id + 1) * 25 // 24000 END AS frames FROM events""")
def time_ticks(spark, sf_dir):
    """Exact rational times reduced, and in samples and frames where they fall on one."""
    t = rational.make(F.col("event_id") + 1, F.lit(24_000))
    rate = lambda n: F.struct(F.lit(n).alias("num"), F.lit(1).alias("den"))
    own = read(spark, sf_dir, "events").select("event_id", t.alias("t"))
    return own.select("event_id", F.col("t.num").alias("num"), F.col("t.den").alias("den"), rational.ticks(F.col("t"), rate(48_000)).alias("samples"), rational.ticks(F.col("t"), rate(25)).alias("frames"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue, turn * 2500 AS start, turn * 2500 + 1700 + length(role) AS stop, 'turn ' || turn || ' ' || role AS text FROM conversations""")
def src3_captions(spark, sf_dir):
    """Turns written as SRT captions and parsed again."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("cue"), (F.col("turn") * 2500).alias("start"), (F.col("turn") * 2500 + 1700 + F.length("role")).alias("stop"), F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" "), "role").alias("text"))
    return _long(captions.parse_srt(captions.encode_srt(c, ["conv_id"]), "conv_id", "srt"), "cue")


@query("""SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS path, lower(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages
  WHERE lower(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '\\.([A-Za-z0-9]+)$', 1)) = 'html'""")
def src2_listing(spark, sf_dir):
    """Listing by extension, in any letter case."""
    own = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    return own.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).where("extension = 'html'")


@query(f"""WITH {CLIPS}, s AS (SELECT track, count(*) AS n, count(DISTINCT source_in - start) AS offsets, max(source_in - start) AS shift FROM clips GROUP BY track)
  SELECT track, n, offsets = 1 AS uniform, CASE WHEN offsets = 1 THEN shift END AS shift FROM s WHERE n > 3""")
def agg12_shift_summary(spark, sf_dir):
    """Tracks of more than three clips: whether all are shifted alike."""
    c = clips(spark, sf_dir).withColumn("o", F.col("source_in") - F.col("start"))
    s = c.groupBy("track").agg(F.count("*").alias("n"), (F.min("o") == F.max("o")).alias("uniform"), F.max("o").alias("o")).where("n > 3")
    return s.select("track", "n", "uniform", F.when(F.col("uniform"), F.col("o")).alias("shift"))
