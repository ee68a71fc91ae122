"""Queries of clocks, exchange documents and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.functions import expressions
from splicework.operators import checks, clocks
from splicework.plans.adapters import CLIPS, WIDTH, WORDS, clips, read, words
from splicework.plans.queries import _SEQ, TRACK, _placed, query
from splicework.sources import captions, otio

_SPEED = """sg AS (SELECT l_orderkey AS track, l_linenumber::BIGINT AS n, max(l_quantity)::BIGINT * 10 AS length, min(l_partkey % 4001) AS rate_a, min(l_suppkey * 37 % 4001) AS rate_b, min(l_partkey) % 5 = 0 AS reverse FROM lineitem GROUP BY ALL),
pl AS (SELECT *, sum(length) OVER w - length AS start, sum(length) OVER w AS stop, sum(s) OVER w - s AS origin FROM (SELECT *, length * (rate_a + rate_b) * CASE WHEN reverse THEN -1 ELSE 1 END AS s FROM sg) WINDOW w AS (PARTITION BY track ORDER BY n ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT l_orderkey AS track, l_partkey AS point, l_partkey % 900 AS at FROM lineitem)"""


@query(f"""WITH {_SPEED} SELECT pt.track, point, pt.at, CASE WHEN pt.at <= stop THEN (origin::HUGEINT * length + CASE WHEN reverse THEN -1 ELSE 1 END * (rate_a * (2 * length * (pt.at - start) - (pt.at - start) * (pt.at - start)) + rate_b * (pt.at - start) * (pt.at - start)))::BIGINT END AS num,
  CASE WHEN pt.at <= stop THEN length * 2000 END AS den FROM pt ASOF JOIN pl ON pl.track = pt.track AND pt.at >= pl.start""")
def jn8_speed_map(spark, sf_dir):
    """The exact source position that each order's speed map gives at some times."""
    lines = read(spark, sf_dir, "lineitem")
    seg = lines.groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("n")).agg(
        (F.max("l_quantity").cast("long") * 10).alias("length"), F.min(F.col("l_partkey") % 4001).cast("long").alias("rate_a"),
        F.min(F.col("l_suppkey") * 37 % 4001).cast("long").alias("rate_b"), (F.min("l_partkey") % 5 == 0).alias("reverse"),
    )
    points = lines.select(F.col("l_orderkey").alias("track"), F.col("l_partkey").alias("point"), (F.col("l_partkey") % 900).cast("long").alias("at"))
    return clocks.source_times(points, seg, TRACK, "n")


_HOLDS = """h AS (SELECT l_orderkey AS track, l_linenumber::BIGINT AS n, max(l_quantity)::BIGINT AS hold FROM lineitem GROUP BY ALL),
f AS (SELECT track, n, sum(hold) OVER w - hold AS a, sum(hold) OVER w AS b, sum(hold) OVER (PARTITION BY track) AS total FROM h WINDOW w AS (PARTITION BY track ORDER BY n ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT l_orderkey AS track, l_partkey AS point, l_partkey % 500 AS at FROM lineitem)"""


@query(f"WITH {_HOLDS} SELECT pt.track, point, pt.at, f.n AS frame FROM pt JOIN f ON f.track = pt.track AND f.a <= pt.at % total AND pt.at % total < f.b")
def jn9_held_frames(spark, sf_dir):
    """The frame a looped animation shows."""
    lines = read(spark, sf_dir, "lineitem")
    holds = lines.groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("n")).agg(F.max("l_quantity").cast("long").alias("hold"))
    points = lines.select(F.col("l_orderkey").alias("track"), F.col("l_partkey").alias("point"), (F.col("l_partkey") % 500).cast("long").alias("at"))
    return clocks.held_frames(points, holds, TRACK, "n", "loop")


@query("""WITH f AS (SELECT doc_id AS track, n * 1000 + n * n % 97 * 7 AS pts FROM (SELECT doc_id, unnest(range(doc_id % 40 + 1)) AS n FROM documents)), l AS (SELECT track, max(pts) AS last FROM f GROUP BY track),
  k AS (SELECT track, unnest(range(last * 24000 // (1001 * 30000) + 1)) AS k FROM l) SELECT k.track, k.k, f.pts FROM k ASOF LEFT JOIN f ON f.track = k.track AND (2 * k.k * 1001 * 30000 + 24000) // (2 * 24000) >= f.pts""")
def int42_conform(spark, sf_dir):
    """Output frames at 24000/1001 a second, and the source frames they show."""
    n = F.col("n")
    frames = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("track"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 40)).alias("n")).select("track", (n * 1000 + n * n % 97 * 7).alias("pts"))
    return clocks.conformed(frames, TRACK, "pts", 24_000, 1001, 30_000)


@query(f"""WITH {CLIPS}, c AS (SELECT track, start AS a, lead(start) OVER (PARTITION BY track ORDER BY start) AS z, layer, id FROM (SELECT track, start, min(layer) AS layer, min(id) AS id FROM clips GROUP BY ALL)),
  g AS (SELECT track, layer, min(start) AS s, max(stop) AS e, min(source_in) AS i FROM clips GROUP BY ALL), r AS (SELECT max(stop) AS b FROM clips), x AS (SELECT track, layer AS angle, a AS start, coalesce(z, b) AS stop FROM c, r)
  SELECT x.track, x.angle, x.start, x.stop, CASE WHEN s <= x.start AND x.stop <= e THEN i + x.start - s END AS source_in FROM x LEFT JOIN g ON g.track = x.track AND g.layer = x.angle""")
def jn21_angle_cuts(spark, sf_dir):
    """Camera cuts as clips of their angles, where those cover them."""
    c = clips(spark, sf_dir)
    end = c.agg(F.max("stop")).first()[0]
    cuts = c.groupBy("track", F.col("start").alias("at")).agg(F.min("layer").alias("angle")).withColumn("_end", F.lit(end))
    angles = c.groupBy("track", F.col("layer").alias("angle")).agg(F.min("start").alias("angle_start"), F.max("stop").alias("angle_stop"), F.min("source_in").alias("angle_in"))
    return clocks.angle_cuts(cuts, angles, TRACK, "_end")


@query(f"""WITH {CLIPS}, p AS (SELECT * FROM clips WHERE id % 2 = 0), s AS (SELECT * FROM clips WHERE id % 2 = 1)
  SELECT p.track, p.id AS picture, s.id AS sound, CASE WHEN s.start - s.source_in > p.start - p.source_in THEN 'sound' ELSE 'picture' END AS late, abs((s.start - s.source_in) - (p.start - p.source_in)) AS off
  FROM p JOIN s ON s.track = p.track AND p.start < s.stop AND s.start < p.stop AND s.start - s.source_in <> p.start - p.source_in WHERE NOT (p.id % 3 = 0 AND s.id // 500 = p.id // 500)""")
def jn3_out_of_sync(spark, sf_dir):
    """Pictures and sounds of one source (here a track's) that play out of step and are not linked."""
    c = clips(spark, sf_dir).withColumn("take", F.floor(F.col("id") / 500))
    even, odd = c.where("id % 2 = 0"), c.where("id % 2 = 1")
    links = even.where("id % 3 = 0").select(F.col("id").alias("picture"), "take", "track").join(odd.select(F.col("id").alias("sound"), "take", "track"), ["take", "track"])
    return clocks.out_of_sync(even, odd, links, [], "track", WIDTH).select("track", "picture", "sound", "late", "off")


@query(f"WITH {CLIPS}, x AS (SELECT DISTINCT id // 3 AS link FROM clips WHERE layer = 3 AND id % 5 <> 0) SELECT track, id FROM clips WHERE (layer = 3) OR (id % 5 <> 0 AND id // 3 IN (SELECT link FROM x))")
def jn13_partners(spark, sf_dir):
    """Chosen clips with those that links tie to them."""
    c = clips(spark, sf_dir).withColumn("link", F.when(F.col("id") % 5 != 0, F.floor(F.col("id") / 3)))
    return clocks.with_partners(c, F.col("layer") == 3, "link").select("track", "id")


@query()
def win24_windows(spark, sf_dir):
    """Stretches of whole hours that hold five clips at most."""
    return clocks.windows_of(clips(spark, sf_dir).where("layer = 1"), TRACK, 6, 5)


@query(f"WITH {_SEQ} SELECT track AS document, 'Video' AS kind, row_number() OVER (PARTITION BY track ORDER BY start) - 1 AS ordinal, 'clip ' || id AS name, 'part/' || source_in AS url, source_in, start, stop FROM pl")
def src4_otio(spark, sf_dir):
    """Orders written as exchange documents and read again."""
    own = _placed(spark, sf_dir).select("track", F.lit(0).alias("lane"), F.lit("Video").alias("kind"), F.concat(F.lit("clip "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("part/"), F.col("source_in").cast("string")).alias("url"), "source_in", "start", "stop")
    documents = otio.exported(own, TRACK, "lane", 25).withColumnRenamed("track", "document")
    return otio.imported(documents, "document", "otio", 25).withColumn("ordinal", F.col("ordinal").cast("long")).drop("track")


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue, turn * 2500 AS start, turn * 2500 + 1700 AS stop, CASE WHEN turn % 3 <> 0 THEN role END AS speaker, 'a < b & c > ' || turn AS text FROM conversations""")
def src3_webvtt(spark, sf_dir):
    """Turns written as WebVTT with their speakers and parsed again."""
    t = F.col("turn")
    c = read(spark, sf_dir, "conversations").select("conv_id", t.alias("cue"), (t * 2500).alias("start"), (t * 2500 + 1700).alias("stop"), F.when(t % 3 != 0, F.col("role")).alias("speaker"), F.concat(F.lit("a < b & c > "), t.cast("string")).alias("text"))
    own = captions.parse_vtt(captions.encode_vtt(c, ["conv_id"]), "conv_id", "vtt")
    return own.withColumn("cue", F.col("cue").cast("long"))


_ACTIONS = """o AS (SELECT o_custkey AS project, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS revision FROM orders),
a AS (SELECT project, revision, o_orderkey, CASE WHEN revision = 0 THEN 'create' WHEN o_orderkey % 4 = 0 THEN 'restore' ELSE 'apply' END AS action FROM o),
h AS (SELECT *, CASE WHEN revision > 0 THEN revision - 1 END - CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS parent, CASE WHEN revision > 0 THEN revision - 1 END AS undo_target,
  CASE WHEN action = 'restore' THEN revision // 2 + CASE WHEN o_orderkey % 8 = 0 THEN 5 ELSE 0 END END AS restored_from, 'state ' || revision % 3 AS snapshot,
  CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE sha256('state ' || revision % 3) END AS snapshot_hash FROM a)"""


def _history(spark, sf_dir) -> DataFrame:
    n = F.row_number().over(W.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey", n.cast("long").alias("revision"))
    r, k = F.col("revision"), F.col("o_orderkey")
    own = own.withColumn("action", F.when(r == 0, "create").when(k % 4 == 0, "restore").otherwise("apply"))
    state = F.concat(F.lit("state "), (r % 3).cast("string"))
    return own.withColumns({
        "parent": F.when(r > 0, r - 1) - F.when(k % 11 == 0, 1).otherwise(0), "undo_target": F.when(r > 0, r - 1),
        "restored_from": F.when(F.col("action") == "restore", F.floor(r / 2) + F.when(k % 8 == 0, 5).otherwise(0)), "snapshot": state,
        "snapshot_hash": F.when(k % 13 == 0, "bad").otherwise(F.sha2(state, 256)),
    })


@query(f"""WITH {_ACTIONS}, x AS (SELECT h.*, t.snapshot AS content FROM h LEFT JOIN h t ON t.project = h.project AND t.revision = h.restored_from)
  SELECT project, revision, 'checksum' AS issue FROM x WHERE snapshot_hash = 'bad' UNION ALL SELECT project, revision, 'parent' FROM x WHERE parent IS DISTINCT FROM CASE WHEN revision > 0 THEN revision - 1 END
  UNION ALL SELECT project, revision, 'undo' FROM x WHERE action <> 'create' AND undo_target IS DISTINCT FROM parent UNION ALL SELECT project, revision, 'restored' FROM x WHERE restored_from >= revision
  UNION ALL SELECT project, revision, 'content' FROM x WHERE action = 'restore' AND content IS NOT NULL AND content <> snapshot""")
def flt16_history(spark, sf_dir):
    """What is wrong with histories that were tampered with."""
    return checks.history(_history(spark, sf_dir), "project")


@query(f"""WITH RECURSIVE {_ACTIONS}, x AS (SELECT project, revision, CASE WHEN action = 'apply' AND o_orderkey % 3 = 0 THEN 'undo' ELSE action END AS action, CASE WHEN action = 'restore' THEN revision // 2 END AS own FROM h),
  t AS (SELECT project, revision, action, own AS restored_from, [NULL::BIGINT] AS backs FROM x WHERE revision = 0
  UNION ALL SELECT x.project, x.revision, x.action, CASE WHEN x.action = 'undo' THEN backs[x.revision] ELSE own END, list_append(backs, CASE WHEN x.action <> 'undo' THEN x.revision - 1 WHEN backs[x.revision] IS NOT NULL THEN backs[backs[x.revision] + 1] END) FROM t JOIN x ON x.project = t.project AND x.revision = t.revision + 1)
  SELECT project, revision, action, restored_from, backs[-1] AS undo_target FROM t""")
def win21_undo(spark, sf_dir):
    """Where undo leads in each history."""
    own = _history(spark, sf_dir)
    return checks.undo_pointers(own.withColumns({"action": F.when((F.col("action") == "apply") & (F.col("o_orderkey") % 3 == 0), "undo").otherwise(F.col("action")), "restored_from": F.when(F.col("action") == "restore", F.floor(F.col("revision") / 2))}), "project")


@query(f"""WITH {CLIPS}, a AS (SELECT doc_id AS asset, 1500 + doc_id % 7 * 900 AS length FROM documents), x AS (SELECT clips.*, max(stop) OVER (PARTITION BY track ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM clips)
  SELECT track, id, 'unknown_asset' AS issue FROM x WHERE asset NOT IN (SELECT asset FROM a) UNION ALL SELECT track, id, 'past_source' FROM x JOIN a ON a.asset = x.asset WHERE source_in + stop - start > length UNION ALL SELECT track, id, 'overlap' FROM x WHERE reach > start""")
def flt8_snapshot(spark, sf_dir):
    """Clips that break a snapshot's rules."""
    assets = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset"), (F.col("doc_id") % 7 * 900 + 1500).alias("length"))
    return checks.snapshot(clips(spark, sf_dir), assets, TRACK, "asset")


@query(f"""WITH {WORDS}, b AS (SELECT asset, pos, word, start - CASE WHEN pos % 50 = 9 THEN 15 ELSE 0 END AS start, stop FROM words), x AS (SELECT *, lag(stop) OVER (PARTITION BY asset ORDER BY pos) AS before FROM b)
  SELECT asset, pos::BIGINT AS pos, 'token' AS issue FROM x WHERE NOT regexp_full_match(word, '[^ \\t\\n\\x0B\\f\\r]+') UNION ALL SELECT asset, pos, 'length' FROM x WHERE stop <= start UNION ALL SELECT asset, pos, 'overlap' FROM x WHERE before > start""")
def flt9_transcript(spark, sf_dir):
    """Words that break a transcript's rules."""
    w = words(spark, sf_dir, beside=True).withColumns({"pos": F.col("pos").cast("long"), "start": F.col("start") - F.when(F.col("pos") % 50 == 9, 15).otherwise(0)})
    return checks.transcript(w, ["asset"], "before")


@query("""SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'unbound' WHEN page_id % 11 = 0 THEN 'changed' ELSE 'online' END AS state FROM pages""")
def flt6_media(spark, sf_dir):
    """Whether media are where they were, and the same."""
    p = read(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.sha2(F.col("page_id").cast("string"), 256).alias("sha256"))
    files = p.where("page_id % 5 <> 0").select("path", F.when(F.col("page_id") % 11 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    return checks.media_states(p.select(F.col("page_id").alias("id"), "path", F.when(F.col("page_id") % 7 != 0, F.col("sha256")).alias("sha256")), files)


@query("""WITH p AS (SELECT doc_id AS id, 'f' || doc_id AS path, sha256(text) AS sha FROM documents), f AS (SELECT path || '.new' AS path, sha FROM p WHERE id % 2 = 0)
  SELECT id, (SELECT min(path) FROM f WHERE f.sha = p.sha) AS path FROM p WHERE sha IN (SELECT sha FROM f)""")
def flt7_relink(spark, sf_dir):
    """Moved media found again by content."""
    p = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return checks.relinked(p, p.where("id % 2 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "sha256"))


_CODES = ("TOOL_FAILED", "TOOL_TIMEOUT", "WORKER_INTERRUPTED", "INVALID_ARGUMENT")


@query(f"""WITH j AS (SELECT l_orderkey AS job, l_linenumber AS attempt, l_quantity::BIGINT % 5 AS most, l_partkey % 9 = 0 AS cancelled, {list(_CODES)}[(l_suppkey % 4 + 1)::INT] AS code FROM lineitem)
  SELECT job, attempt, CASE WHEN cancelled THEN 'cancelled' WHEN most BETWEEN 1 AND 3 AND attempt < most AND code <> 'INVALID_ARGUMENT' THEN 'queued' WHEN code = 'WORKER_INTERRUPTED' THEN 'interrupted' ELSE 'failed' END AS status FROM j""")
def flt17_retry(spark, sf_dir):
    """What becomes of failed jobs."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    jobs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity").cast("long") % 5).alias("most"), (F.col("l_partkey") % 9 == 0).alias("cancelled"), code.alias("code"))
    return checks.after_failure(jobs).select("job", "attempt", "status")


@query("""SELECT l_orderkey AS project, o_custkey AS request, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def jn24_requests(spark, sf_dir):
    """Revisions with their requests: an equality join."""
    o, lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).groupBy(F.col("l_orderkey").alias("project"), F.col("o_custkey").alias("request")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey % 97 AS parent, (c_custkey % 97 * 5 + 1) % 97 % 60 AS child FROM customer), t AS (SELECT parent, child, 1 AS d FROM e UNION SELECT t.parent, e.child, d + 1 FROM t JOIN e ON e.parent = t.child WHERE d < 8)
  SELECT parent AS node, min(d)::INTEGER AS steps FROM t WHERE parent = child GROUP BY parent""")
def jn16_cycles(spark, sf_dir):
    """Nodes that lie on a cycle of eight steps at most."""
    p = F.col("c_custkey") % 97
    return checks.cycles(read(spark, sf_dir, "customer").select(p.alias("parent"), ((p * 5 + 1) % 97 % 60).alias("child")), 8)


@query(f"WITH {CLIPS} SELECT track, id FROM clips WHERE layer = 2 AND track % 4 = 1")
def flt14_locked(spark, sf_dir):
    """Chosen clips on locked tracks."""
    c = clips(spark, sf_dir)
    return checks.locked(c, c.select("track", (F.col("track") % 4 == 1).alias("locked")), TRACK, F.col("layer") == 2).select("track", "id")


GRAPH = {
    "t": ("column", "t"), "two": ("literal", (2, 1)), "seven": ("literal", (7, 1)), "third": ("literal", (1, 3)),
    "twice": ("multiply", "t", "two"), "wave": ("modulo", "twice", "seven"), "early": ("less", "wave", "two"),
    "up": ("add", "wave", "third"), "inverse": ("divide", "two", "wave"), "value": ("select", "early", "up", "inverse"),
}


@query("""WITH w AS (SELECT event_id, (event_id % 120 * 2) % 84 AS w FROM events), n AS (SELECT event_id, w, CASE WHEN w < 24 THEN w + 4 ELSE 24 END AS num, CASE WHEN w < 24 THEN 12 ELSE w END AS den FROM w)
  SELECT event_id, CASE WHEN w > 0 THEN num // gcd(num, den) END AS num, CASE WHEN w > 0 THEN den // gcd(num, den) END AS den, CASE WHEN w = 0 THEN 'domain' END AS error FROM n""")
def expr_graph(spark, sf_dir):
    """An expression graph at the events' times, in twelfths; its division fails at zero also where it is not chosen."""
    t = F.struct((F.col("event_id") % 120).cast("long").alias("num"), F.lit(12).cast("long").alias("den"))
    own = expressions.evaluated(read(spark, sf_dir, "events").select("event_id", t.alias("t")), GRAPH, ["value"])
    return own.select("event_id", F.col("value.num").alias("num"), F.col("value.den").alias("den"), "error")
