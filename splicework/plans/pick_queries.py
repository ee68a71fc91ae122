"""Queries of neighbours, events, peaks, findings, references, look-ups and published tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from splicework.operators import intervals as iv
from splicework.operators import picks, snapshots, sound
from splicework.operators import tracks as tr
from splicework.operators.tables import published, shared_folder
from splicework.plans.adapters import CLIPS, WIDTH, WORDS, clips, read, words
from splicework.plans.queries import _LEVEL, _SEQ, TRACK, _levels, _placed, query
from splicework.plans.reading_queries import _TURNS, _turns
from splicework.plans.sound_queries import _SAMPLES, _samples


@query(f"WITH {_SEQ} SELECT l.track, l.id AS left_id, r.id AS right_id, l.stop AS at FROM pl l JOIN pl r ON r.track = l.track AND r.start = l.stop")
def jn5_adjacent(spark, sf_dir):
    """Clips that touch."""
    return picks.adjacent(_placed(spark, sf_dir), TRACK)


@query(f"""WITH {CLIPS}, e AS (SELECT track, id, stop AS at, 0 AS rank, 'end' AS kind FROM clips UNION ALL SELECT track, id, start, 1, 'start' FROM clips) SELECT track, id, at, kind, row_number() OVER (PARTITION BY track ORDER BY "at", rank, id)::INTEGER AS place FROM e""".replace(" AS at,", ' AS "at",').replace("id, at, kind", 'id, "at", kind'))
def ord1_events(spark, sf_dir):
    """Starts and ends of clips in order, ends first."""
    return picks.events(clips(spark, sf_dir), TRACK)


@query(f"""WITH RECURSIVE {_LEVEL}, r AS (SELECT track, id, db, row_number() OVER (PARTITION BY track ORDER BY db DESC, id) AS n FROM lv), t AS (SELECT track, 1::BIGINT AS pick, [id] AS ids, id, db FROM r WHERE n = 1
  UNION ALL SELECT track, pick + 1, list_append(ids, k[1]), k[1], k[2] FROM (SELECT t.track, t.pick, t.ids, arg_min([r.id, r.db], r.n) AS k FROM t JOIN r ON r.track = t.track WHERE t.pick < 32 AND list_bool_and(list_transform(t.ids, lambda p: abs(p - r.id) >= 128)) GROUP BY ALL))
  SELECT track, id, db, pick FROM t""")
def ord4_peaks(spark, sf_dir):
    """The 32 greatest levels of each track, 128 places or more apart."""
    return picks.peaks(_levels(spark, sf_dir), TRACK, "id", "db", 32, 128)


# The two filters of K-weighting at 48 kHz.
SHELF = ((1.53512485958697, -2.69169618940638, 1.19839281085285), (-1.69065929318241, 0.73248077421585))
PASS = ((1.0, -2.0, 1.0), (-1.99004745483398, 0.99007225036621))


def _step(x: str, x1: str, x2: str, y1: str, y2: str, f: tuple) -> str:
    (b0, b1, b2), (a1, a2) = f
    return f"({b0!r}::DOUBLE * {x} + {b1!r}::DOUBLE * {x1} + {b2!r}::DOUBLE * {x2} - {a1!r}::DOUBLE * {y1} - {a2!r}::DOUBLE * {y2})"


_U = _step("sm.v::DOUBLE", "f.x", "f.x1", "f.u", "f.u1", SHELF)


@query(f"""WITH RECURSIVE {_SAMPLES}, f AS (SELECT track, k, v::DOUBLE AS x, 0.0::DOUBLE AS x1, v::DOUBLE * {SHELF[0][0]!r}::DOUBLE AS u, 0.0::DOUBLE AS u1, v::DOUBLE * {SHELF[0][0]!r}::DOUBLE AS y, 0.0::DOUBLE AS y1 FROM sm WHERE k = 0
  UNION ALL SELECT sm.track, sm.k, sm.v::DOUBLE, f.x, {_U}, f.u, {_step(_U, 'f.u', 'f.u1', 'f.y', 'f.y1', PASS)}, f.y FROM f JOIN sm ON sm.track = f.track AND sm.k = f.k + 1) SELECT track, k, round(y, 3) AS weighted FROM f""")
def win14_k_weighting(spark, sf_dir):
    """Each track's samples weighted as ears do: a shelf, and a high pass."""
    own = sound.filtered(_samples(spark, sf_dir), TRACK, "k", "v", *SHELF)
    return sound.filtered(own, TRACK, "k", "filtered", *PASS).select("track", "k", F.round("filtered", 3).alias("weighted"))


_EDGES = """e AS (SELECT n_regionkey AS parent, 100 + n_nationkey AS child FROM nation UNION SELECT 100 + c_nationkey, 1000 + c_custkey FROM customer)"""


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT parent, child FROM e UNION SELECT t.parent, e.child FROM t JOIN e ON e.parent = t.child) SELECT parent AS sequence, count(*) AS dependents, count(*) FILTER (child % 9 = 0) AS locked FROM t GROUP BY parent""")
def jn15_locked(spark, sf_dir):
    """How many sequences depend on each, and how many of those are locked."""
    e = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") + 100).cast("long").alias("child"))
    e = e.unionByName(read(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("parent"), (F.col("c_custkey") + 1000).cast("long").alias("child"))).distinct()
    own = snapshots.descendants(e, 8)
    return own.groupBy(F.col("parent").alias("sequence")).agg(F.count("*").alias("dependents"), F.count_if(F.col("child") % 9 == 0).alias("locked"))


@query(f"""WITH {_SEQ} SELECT track, id AS left_id, id + 1 AS right_id, CASE WHEN id % 3 = 0 THEN 2 ELSE 4 END AS before, 6 AS after, CASE WHEN id % 3 = 0 THEN 'wipe' ELSE 'dissolve' END AS kind FROM pl WHERE id % 2 = 1 AND id % 5 <> 0 UNION ALL SELECT track, id, id + 1, 1, 1, 'dip' FROM pl WHERE id % 4 = 2""")
def int21_set(spark, sf_dir):
    """Transitions set, changed and taken away."""
    c, key = _placed(spark, sf_dir), F.col("id")
    pair = ["track", key.alias("left_id"), (key + 1).alias("right_id")]
    rows = c.where("id % 2 = 1").select(*pair, F.lit(4).alias("before"), F.lit(6).alias("after"), F.lit("dissolve").alias("kind"))
    change = c.where("id % 2 = 1").select(*pair, F.when(key % 3 == 0, 2).alias("before"), F.lit(None).cast("int").alias("after"), F.when(key % 3 == 0, "wipe").alias("kind"), (key % 5 == 0).alias("_drop"))
    new = c.where("id % 4 = 2").select(*pair, F.lit(1).alias("before"), F.lit(1).alias("after"), F.lit("dip").alias("kind"), F.lit(False).alias("_drop"))
    return tr.upserted(rows, change.unionByName(new), ["track", "left_id", "right_id"])


@query(f"""WITH {_TURNS}, n AS (SELECT coalesce(c.conv_id, e.conv_id) AS conv_id, coalesce(c.turn, e.turn) AS id, CASE WHEN c.turn IS NULL OR op = 'replace' THEN e.start ELSE c.start END AS start FROM c FULL JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn WHERE CASE WHEN c.turn IS NULL THEN op = 'add' ELSE coalesce(op <> 'remove', true) END)
  SELECT a.conv_id, a.id, b.id AS other_id FROM n a JOIN n b ON b.conv_id = a.conv_id AND a.id < b.id AND a.start < b.start + 2490 AND b.start < a.start + 2490""")
def int38_overlaps(spark, sf_dir):
    """Cues that overlap once they are edited."""
    c, e = _turns(spark, sf_dir)
    own = snapshots.edited(c, e, ["conv_id", "turn"], ["start", "text"]).select("conv_id", F.col("turn").alias("id"), "start", (F.col("start") + 2490).alias("stop"))
    return iv.collisions(own, ["conv_id"], 5000)


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, 'speaker' AS loss FROM c WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn, 'style' FROM c WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'blank_line' FROM c WHERE regexp_matches(text, '\\n[ \\t]*\\n')""")
def snk2_losses(spark, sf_dir):
    """What SRT cannot hold of each turn: speakers, styles, blank lines."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return picks.caption_losses(c, ["conv_id", "turn"], {"speaker": F.col("turn") % 3 != 0, "style": F.col("role") == "assistant", "blank_line": F.col("text").rlike("\n[ \t]*\n")})


@query(f"""WITH {CLIPS}, {WORDS}, cw AS (SELECT c.id, count(*) AS n FROM clips c JOIN words w ON w.asset = c.asset AND w.start < c.source_in + c.stop - c.start AND c.source_in < w.stop WHERE w.start < c.source_in OR w.stop > c.source_in + c.stop - c.start GROUP BY c.id),
  tc AS (SELECT l.id, r.source_in - (l.source_in + l.stop - l.start) AS jump FROM clips l JOIN clips r ON r.track = l.track AND r.start = l.stop AND r.asset = l.asset)
  SELECT 'disabled_track' AS issue, track AS subject, count(*) AS n, 'warning' AS severity FROM clips WHERE track % 8 = 0 GROUP BY track UNION ALL SELECT 'cut_word', id, n, 'notice' FROM cw UNION ALL SELECT 'jump_cut', id, jump, 'notice' FROM tc WHERE jump <> 0 AND abs(jump) < 100
  UNION ALL SELECT 'changed_media', doc_id, length(text), 'error' FROM documents WHERE doc_id % 31 = 0 UNION ALL SELECT 'unmatched_transcript', doc_id, 0, 'notice' FROM documents WHERE doc_id NOT IN (SELECT asset FROM clips)""")
def int39_findings(spark, sf_dir):
    """More of what may be wrong with a timeline, with its severity."""
    c, d = clips(spark, sf_dir), read(spark, sf_dir, "documents")
    source = c.select("id", "asset", F.col("source_in").alias("start"), (F.col("source_in") + F.col("stop") - F.col("start")).alias("stop"))
    hit = iv.overlap_join(source, words(spark, sf_dir, source), ["asset"], WIDTH).where("other_start < start OR other_stop > stop").groupBy("id").agg(F.count("*").alias("n"))
    side = lambda s: c.select(F.col("id").alias(f"{s}_id"), F.col("asset").alias(f"{s}_asset"), F.col("source_in").alias(f"{s}_in"), (F.col("stop") - F.col("start")).alias(f"{s}_n"))
    touch = picks.adjacent(c, TRACK).join(side("left"), "left_id").join(side("right"), "right_id").where("left_asset = right_asset")
    jump = touch.withColumn("jump", F.col("right_in") - F.col("left_in") - F.col("left_n")).where("jump <> 0 AND abs(jump) < 100")
    alone = d.select("doc_id").join(c.select(F.col("asset").alias("doc_id")).distinct(), "doc_id", "left_anti")
    parts = {
        "disabled_track": (c.where("track % 8 = 0").groupBy("track").agg(F.count("*").alias("n")), "track", F.col("n")), "cut_word": (hit, "id", F.col("n")), "jump_cut": (jump, "left_id", F.col("jump")),
        "changed_media": (d.where("doc_id % 31 = 0"), "doc_id", F.length("text")), "unmatched_transcript": (alone, "doc_id", F.lit(0)),
    }
    return picks.findings(parts, {"changed_media": "error", "cut_word": "notice", "jump_cut": "notice", "unmatched_transcript": "notice"})


@query("""SELECT o_orderkey AS request, 'c' || o_custkey AS file, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_nationkey::VARCHAR END AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0""")
def src6_documents(spark, sf_dir):
    """References to files, and to a part of what is in them."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.when(F.col("o_orderkey") % 3 == 0, "name").when(F.col("o_orderkey") % 3 == 1, "nation").otherwise("none").alias("select"))
    files = read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("content"))
    return picks.resolved(o, files).select("request", "file", "value")


_ERRORS = (("TOOL_FAILED", "once", "look at the tool's own message"), ("TOOL_TIMEOUT", "later", "try again with more time"), ("INVALID_ARGUMENT", "never", "mend the request"), ("UNKNOWN", "never", "report it"))
_CODES = ("TOOL_FAILED", "TOOL_TIMEOUT", "INVALID_ARGUMENT", "NO_SUCH_CODE")


@query(f"""WITH j AS (SELECT l_orderkey AS job, l_linenumber AS attempt, {list(_CODES)}[(l_suppkey % 4 + 1)::INT] AS code FROM lineitem), e(code, retry, hint) AS (VALUES {', '.join(repr(e).replace("tool's", "tool''s").replace('"', "'") for e in _ERRORS)})
  SELECT job, attempt, j.code, coalesce(e.retry, u.retry) AS retry, coalesce(e.hint, u.hint) AS hint FROM j LEFT JOIN e ON e.code = j.code, (SELECT * FROM e WHERE code = 'UNKNOWN') u""")
def flt13_errors(spark, sf_dir):
    """What to do about each failure, by its code."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    jobs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("attempt"), code.alias("code"))
    return picks.looked_up(jobs, spark.createDataFrame(_ERRORS, "code string, retry string, hint string"), "code")


@query("SELECT p_partkey, p_size FROM part")
def snk1_published(spark, sf_dir):
    """A table published under a new name, and read there."""
    path = f"{shared_folder(spark)}/splicework/published-{uuid.uuid4().hex}"
    return published(read(spark, sf_dir, "part").select("p_partkey", "p_size"), path)


@query(f"""WITH {CLIPS}, p AS (SELECT track, id, start AS pts, id % 12 = 0 AS kf, id % 5 * 480 AS n, row_number() OVER w - 1 AS frame FROM clips WINDOW w AS (PARTITION BY track ORDER BY start, id))
  SELECT track, id, frame::INTEGER AS frame, pts, lead(pts) OVER w - pts AS length, (max(CASE WHEN kf THEN frame END) OVER (w ROWS UNBOUNDED PRECEDING))::INTEGER AS anchor, (sum(n) OVER (w ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS samples_before FROM p WINDOW w AS (PARTITION BY track ORDER BY pts, id)""")
def src9_index(spark, sf_dir):
    """Frames of each track in order, with the key frame that each needs and the sound before it."""
    c = clips(spark, sf_dir).select("track", "id", F.col("start").alias("pts"), (F.col("id") % 12 == 0).alias("key_frame"), (F.col("id") % 5 * 480).alias("samples"))
    return picks.frame_index(c, TRACK)
