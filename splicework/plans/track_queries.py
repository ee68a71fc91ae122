"""Queries of track edits, links, attributes, pages and snapshots over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicework.operators import intervals as iv
from splicework.operators import tracks as tr
from splicework.plans.adapters import CLIPS, WIDTH, clips, read
from splicework.plans.clock_queries import _ACTIONS, _history
from splicework.plans.queries import _PIECES, _SPLIT, TRACK, _cuts, _middle, query

PLACED = ["track", "id", "start", "stop", "source_in"]
_LINES = "ln AS (SELECT l_orderkey AS track, l_linenumber::BIGINT AS id, sum(l_quantity::BIGINT)::BIGINT AS n, min(l_partkey) AS source_in FROM lineitem GROUP BY ALL)"


def _lines(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("id"))
    return lines.agg(F.sum(F.col("l_quantity").cast("long")).alias("n"), F.min("l_partkey").alias("source_in"))


@query(f"""WITH {_LINES}, t AS (SELECT track, id, CASE WHEN id = 2 THEN source_in + 3 ELSE source_in END AS source_in, CASE WHEN id = 2 THEN greatest(1, n // 2) ELSE n END AS n FROM ln)
  SELECT track, id, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop, source_in FROM t WINDOW w AS (PARTITION BY track ORDER BY id)""")
def int7_trim(spark, sf_dir):
    """Each second clip trimmed to half its length, three ticks in; later clips move up."""
    own = _lines(spark, sf_dir)
    trims = own.where("id = 2").select("track", "id", (F.col("source_in") + 3).alias("new_in"), F.greatest(F.lit(1), F.floor(F.col("n") / 2)).alias("new_length"))
    return tr.trimmed(own, trims, TRACK, "id", "n").select(*PLACED)


@query(f"""WITH {_LINES}, k AS (SELECT track, id, n, source_in FROM ln WHERE id <> 1), a AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY late, o) AS ordinal FROM
  (SELECT *, 0 AS late, id AS o FROM k UNION ALL SELECT o_orderkey, 100, 7, 0, 1, 1 FROM orders))
  SELECT track, id, ordinal, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop, source_in FROM a WINDOW w AS (PARTITION BY track ORDER BY ordinal)""")
def int8_append(spark, sf_dir):
    """Each first clip removed, and a clip of seven ticks appended."""
    own = _lines(spark, sf_dir).withColumn("ordinal", F.col("id"))
    gone = own.where("id = 1").select("track", "id")
    more = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"), F.lit(100).cast("long").alias("id"), F.lit(7).cast("long").alias("n"), F.lit(0).cast("long").alias("source_in"), F.lit(1).cast("long").alias("ordinal"))
    rows = tr.appended(tr.removed(own, gone, TRACK), more, TRACK, "ordinal")
    return iv.placed(rows, TRACK, "ordinal", "n").select("track", "id", "ordinal", "start", "stop", "source_in")


_MOVES = f"""WITH {CLIPS}, mv AS (SELECT (track + id % 2) AS track, track AS old, id, layer, asset, start + 400 AS start, stop + 400 AS stop, source_in FROM clips WHERE id % 9 = 0),
  clash AS (SELECT a.track, a.id, b.id AS other_id FROM mv a JOIN mv b ON a.track = b.track AND a.id < b.id AND a.start < b.stop AND b.start < a.stop),
  ok AS (SELECT * FROM mv WHERE track NOT IN (SELECT track FROM clash)),
  st AS (SELECT c.* FROM clips c WHERE id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.track = c.track AND ok.start < c.stop AND c.start < ok.stop)
    UNION ALL SELECT c.* FROM clips c JOIN mv ON mv.old = c.track AND mv.id = c.id WHERE mv.track IN (SELECT track FROM clash))"""


def _moved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = clips(spark, sf_dir)
    moves = c.where("id % 9 = 0").select("track", "id", F.lit(400).cast("long").alias("shift"), (F.col("track") + F.col("id") % 2).alias("target"))
    return tr.moved(c.select(*PLACED), moves, TRACK, WIDTH)


@query(_MOVES + " SELECT track, id, start, stop, source_in FROM st UNION ALL SELECT track, id, start, stop, source_in FROM ok")
def int17_move(spark, sf_dir):
    """Every ninth clip moved on by 400 ticks, some to the next track, in place of what is there."""
    return _moved(spark, sf_dir)[0].select(*PLACED)


@query(_MOVES + " SELECT * FROM clash")
def int17_clash(spark, sf_dir):
    """Moved clips that meet one another, whose tracks are left alone."""
    return _moved(spark, sf_dir)[1]


_LINKS = "lk AS (SELECT id // 3 AS link, id AS clip, start, source_in FROM clips WHERE id % 7 < 5)"


def _links(c: DataFrame) -> DataFrame:
    return c.where("id % 7 < 5").select(F.expr("id div 3").alias("link"), F.col("id").alias("clip"), "start", "source_in")


@query(f"""WITH {CLIPS}, {_LINKS}, h AS (SELECT id AS clip FROM clips WHERE id % 10 = 0), g AS (SELECT clip FROM h UNION SELECT clip FROM lk WHERE link IN (SELECT link FROM lk WHERE clip IN (SELECT clip FROM h)))
  SELECT track, id, start, stop, source_in FROM clips WHERE id NOT IN (SELECT clip FROM g)""")
def int17_remove(spark, sf_dir):
    """Every tenth clip removed, with the clips that are linked to it."""
    c = clips(spark, sf_dir)
    gone = tr.with_partners(c.where("id % 10 = 0").select(F.col("id").alias("clip")), _links(c))
    return c.join(gone.select(F.col("clip").alias("id")), "id", "left_anti").select(*PLACED)


@query(f"""WITH {CLIPS}, {_LINKS}, kept AS (SELECT * FROM lk WHERE link % 4 <> 0), ch AS (SELECT id // 6 + 100000000 AS new, id AS clip FROM clips WHERE id % 5 = 1 OR id % 7 >= 5),
  n AS (SELECT link, count(*) AS n FROM kept GROUP BY link), part AS (SELECT new FROM (SELECT new, link, count(*) AS m FROM ch JOIN kept USING (clip) GROUP BY ALL) JOIN n USING (link) WHERE m < n)
  SELECT link, clip, start, source_in FROM kept UNION ALL SELECT new, clip, start, source_in FROM ch JOIN clips ON id = clip WHERE new NOT IN (SELECT new FROM part)""")
def int18_links(spark, sf_dir):
    """Links taken away and made; none takes a part of another's members."""
    c = clips(spark, sf_dir)
    links = _links(c)
    chosen = c.where("id % 5 = 1 OR id % 7 >= 5").select(F.expr("id div 6 + 100000000").alias("link"), F.col("id").alias("clip"))
    return tr.relinked(links, c, links.where("link % 4 = 0").select("link"), chosen)


@query(_SPLIT + f""", {_LINKS}, k AS (SELECT id AS clip, max(part) + 1 AS n FROM sp GROUP BY id), j AS (SELECT link, clip, n, min(n) OVER (PARTITION BY link) = max(n) OVER (PARTITION BY link) AS fits FROM lk JOIN k USING (clip))
  SELECT link, unnest(range(n))::INTEGER AS part, clip, fits FROM j""")
def int16_links(spark, sf_dir):
    """Links after all clips were split at one time."""
    c = clips(spark, sf_dir)
    parts = iv.split_at(c, F.lit(_middle(c))).select(F.col("id").alias("clip"), "part")
    return tr.links_of_parts(_links(c).select("link", "clip"), parts)


@query(_PIECES + """ SELECT p.track, p.id, p.start, p.stop, CASE WHEN p.start > c.start THEN 0 ELSE c.id % 4 * 60 END AS fade_in, CASE WHEN p.stop < c.stop THEN 0 ELSE c.id % 3 * 90 END AS fade_out,
  (c.id % 4 > 0 OR c.id % 3 > 0) AND ((p.start > c.start AND (p.start - c.start < c.id % 4 * 60 OR c.stop - p.start < c.id % 3 * 90)) OR (p.stop < c.stop AND (p.stop - c.start < c.id % 4 * 60 OR c.stop - p.stop < c.id % 3 * 90))) AS inside
  FROM pieces p JOIN clips c ON c.track = p.track AND c.id = p.id""")
def int16_fades(spark, sf_dir):
    """The fades of the pieces that cuts leave."""
    c = clips(spark, sf_dir).withColumns({"fade_in": F.col("id") % 4 * 60, "fade_out": F.col("id") % 3 * 90})
    pieces = iv.subtracted(c, _cuts(c), TRACK, WIDTH).select("track", "id", "start", "stop")
    return tr.faded_parts(pieces, c, TRACK)


@query("""SELECT coalesce(c_custkey, 0) AS track, CASE WHEN c_custkey % 5 = 0 THEN true ELSE c_custkey % 3 = 0 END AS locked, CASE WHEN c_custkey % 7 = 0 THEN false ELSE true END AS enabled, 'normal' AS composite FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT -s_suppkey, false, true, 'screen' FROM supplier""")
def int19_tracks(spark, sf_dir):
    """Tracks whose state is changed, tracks taken away and tracks added."""
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(key.alias("track"), (key % 3 == 0).alias("locked"), F.lit(True).alias("enabled"), F.lit("normal").alias("composite"))
    state = rows.select("track", F.when(F.col("track") % 5 == 0, True).alias("locked"), F.when(F.col("track") % 7 == 0, False).alias("enabled"), F.lit(None).cast("string").alias("composite"), (F.col("track") % 11 == 0).alias("_drop"))
    new = read(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("track"), F.lit(False).alias("locked"), F.lit(True).alias("enabled"), F.lit("screen").alias("composite"), F.lit(False).alias("_drop"))
    return tr.upserted(rows, state.unionByName(new), TRACK)


@query(f"""WITH {CLIPS} SELECT id, CASE WHEN id % 6 = 0 THEN 500 ELSE 1000 END AS gain_milli, CASE WHEN id % 8 = 0 THEN 120 ELSE 0 END AS fade_in, CASE WHEN id % 10 = 0 THEN 'multiply' ELSE 'normal' END AS blend FROM clips""")
def int22_attributes(spark, sf_dir):
    """Gains, fades and blends set on some clips."""
    ids = clips(spark, sf_dir).select("id")
    rows = ids.withColumns({"gain_milli": F.lit(1000), "fade_in": F.lit(0), "blend": F.lit("normal")})
    changes = ids.where("id % 6 = 0 OR id % 8 = 0 OR id % 10 = 0").select("id", F.when(F.col("id") % 6 == 0, 500).alias("gain_milli"), F.when(F.col("id") % 8 == 0, 120).alias("fade_in"), F.when(F.col("id") % 10 == 0, "multiply").alias("blend"))
    return tr.upserted(rows, changes, ["id"])


@query("""SELECT p_partkey AS sequence, p_size::BIGINT * 25 AS duration, CASE WHEN p_partkey % 4 = 0 THEN 'angle ' || p_partkey % 3 ELSE 'main' END AS angle FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT -s_suppkey, 250, 'main' FROM supplier""")
def int24_sequences(spark, sf_dir):
    """Sequences made, cut to another angle and taken away."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(key.alias("sequence"), (F.col("p_size").cast("long") * 25).alias("duration"), F.lit("main").alias("angle"))
    edits = rows.select("sequence", F.lit(None).cast("long").alias("duration"), F.when(F.col("sequence") % 4 == 0, F.concat(F.lit("angle "), (F.col("sequence") % 3).cast("string"))).alias("angle"), (F.col("sequence") % 13 == 0).alias("_drop"))
    new = read(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("sequence"), F.lit(250).cast("long").alias("duration"), F.lit("main").alias("angle"), F.lit(False).alias("_drop"))
    return tr.upserted(rows, edits.unionByName(new), ["sequence"])


@query("""SELECT doc_id AS asset, CASE WHEN doc_id % 3 = 0 THEN 'moved/' || doc_id ELSE 'media/' || doc_id END AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'proxy/' || doc_id END AS proxy FROM documents
  UNION ALL SELECT page_id + 1000000000, url, NULL, NULL FROM pages""")
def int25_assets(spark, sf_dir):
    """Assets added, bound to their content, moved and given proxies."""
    docs, name = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    rows = docs.select(F.col("doc_id").alias("asset"), F.concat(F.lit("media/"), name).alias("path"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("proxy"))
    some = lambda n, value: F.when(F.col("doc_id") % n == 0, value)
    edits = docs.select(F.col("doc_id").alias("asset"), some(3, F.concat(F.lit("moved/"), name)).alias("path"), some(5, F.sha2("text", 256)).alias("sha256"), some(4, F.concat(F.lit("proxy/"), name)).alias("proxy"))
    new = read(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("asset"), F.col("url").alias("path"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("proxy"))
    return tr.upserted(rows, edits.unionByName(new), ["asset"])


@query(_PIECES + " SELECT track, id, start, stop, source_in, row_number() OVER (PARTITION BY track, id ORDER BY start) - 1 AS part FROM pieces")
def int28_lift(spark, sf_dir):
    """Stretches lifted out of tracks; nothing else moves."""
    c = clips(spark, sf_dir)
    return tr.lifted(c, _cuts(c), TRACK, WIDTH).select(*PLACED, "part")


@query(f"""WITH {CLIPS}, r AS (SELECT (min(start) + max(stop)) // 2 AS a, (min(start) + max(stop)) // 2 + 40000 AS z FROM clips) SELECT track, id, greatest(start, a) - a AS start, least(stop, z) - a AS stop, source_in + greatest(start, a) - start AS source_in
  FROM clips, r WHERE start < z AND a < stop""")
def flt5_range(spark, sf_dir):
    """A range of all tracks, from its own zero."""
    c = clips(spark, sf_dir)
    return _range(c)[0].select(*PLACED)


def _range(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = _middle(c)
    return tr.range_of(c, c.select("track", F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id")), F.lit(a), F.lit(a + 40_000))


@query(f"""WITH {CLIPS}, r AS (SELECT (min(start) + max(stop)) // 2 AS a, (min(start) + max(stop)) // 2 + 40000 AS z FROM clips), w AS (SELECT id FROM clips, r WHERE start >= a AND stop <= z)
  SELECT track, id AS left_id, id + 1 AS right_id FROM clips WHERE id IN (SELECT id FROM w) AND id + 1 IN (SELECT id FROM w)""")
def flt5_transitions(spark, sf_dir):
    """The transitions of that range."""
    return _range(clips(spark, sf_dir))[1].select("track", "left_id", "right_id")


_KEYS = """ks AS (SELECT l_orderkey AS curve, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS index, (l_partkey % 5 * (l_suppkey % 3 + 1) * CASE WHEN l_partkey % 17 = 0 THEN 2000003 ELSE 1 END)::BIGINT AS num,
  ((l_suppkey % 3 + 1) * CASE WHEN l_partkey % 17 = 0 THEN 1000003 ELSE 1 END)::BIGINT AS den, l_quantity::BIGINT * 3 AS value, 7 AS end_num, 2 AS end_den FROM lineitem),
kr AS (SELECT *, num // greatest(1, gcd(num, den)) AS n, den // greatest(1, gcd(num, den)) AS d FROM ks)"""


@query(f"""WITH {_KEYS} SELECT curve, index, 'late' AS issue FROM kr WHERE num::HUGEINT * end_den > end_num::HUGEINT * den UNION ALL SELECT curve, index, 'coarse' FROM kr WHERE d > 1000000 UNION ALL SELECT curve, index, 'range' FROM kr WHERE value NOT BETWEEN 5 AND 140
  UNION ALL SELECT curve, index, 'equal' FROM kr QUALIFY row_number() OVER (PARTITION BY curve, n, d ORDER BY index) > 1 UNION ALL SELECT curve, NULL, 'count' FROM kr GROUP BY curve HAVING count(*) > 6""")
def flt11_curves(spark, sf_dir):
    """Curves with keys at equal times, past their end, too fine or out of range."""
    from pyspark.sql import window as W

    n = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    k, s = F.col("l_partkey"), F.col("l_suppkey") % 3 + 1
    own = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("curve"), n.alias("index"), (k % 5 * s * F.when(k % 17 == 0, 2_000_003).otherwise(1)).cast("long").alias("num"), (s * F.when(k % 17 == 0, 1_000_003).otherwise(1)).cast("long").alias("den"),
        (F.col("l_quantity").cast("long") * 3).alias("value"), F.lit(7).cast("long").alias("end_num"), F.lit(2).cast("long").alias("end_den"),
    )
    return tr.curve_issues(own, ["curve"], 5, 140, 6)


@query(f"""WITH {CLIPS}, p AS (SELECT track, id, start, row_number() OVER (PARTITION BY track ORDER BY start, id) AS n, count(*) OVER (PARTITION BY track) AS total FROM clips) SELECT track, id, start, total, CASE WHEN total > 15 THEN 15 END AS next_offset FROM p WHERE n > 10 AND n <= 15""")
def ord2_page(spark, sf_dir):
    """The third page, of five clips, of each track."""
    return tr.page(clips(spark, sf_dir).select("track", "id", "start"), TRACK, ["start", "id"], 10, 5)


@query(f"""WITH {CLIPS} SELECT track, (list(id ORDER BY start, id))[1:20] AS listed, count(*) AS count FROM clips GROUP BY track""")
def ord3_listed(spark, sf_dir):
    """The first twenty clips of each track, and how many there are."""
    return tr.listed(clips(spark, sf_dir).select("track", "id", "start"), TRACK, ["start", "id"], "id", 20)


@query(r"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS words, string_split(text, chr(10)) AS lines FROM documents)
  SELECT doc_id, words[1:5] AS words, lines[1:5] AS lines, len(words)::INTEGER AS n_words, len(lines)::INTEGER AS n_lines, list_filter([CASE WHEN len(words) > 5 THEN 'words' END, CASE WHEN len(lines) > 5 THEN 'lines' END], lambda x: x IS NOT NULL) AS shortened FROM d""")
def snk10_summary(spark, sf_dir):
    """Long lists of a result cut to five, with their counts."""
    own = read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"), F.split("text", "\n").alias("lines"))
    return tr.shortened(own, ["doc_id"], ["words", "lines"], 5)


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/media/in/' || page_id WHEN 1 THEN 'C:\\elsewhere\\' || page_id WHEN 2 THEN 'rel/' || page_id ELSE '/media/in\\sub\\' || page_id END AS path FROM pages)
  SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN page_id::VARCHAR WHEN 3 THEN 'sub/' || page_id END AS portable FROM p WHERE page_id % 4 <> 2""")
def snk4_portable(spark, sf_dir):
    """Absolute paths as paths below the media folder."""
    name, n = F.col("page_id").cast("string"), F.col("page_id") % 4
    path = F.when(n == 0, F.concat(F.lit("/media/in/"), name)).when(n == 1, F.concat(F.lit("C:\\elsewhere\\"), name)).when(n == 2, F.concat(F.lit("rel/"), name)).otherwise(F.concat(F.lit("/media/in\\sub\\"), name))
    return tr.portable(read(spark, sf_dir, "pages").select("page_id", path.alias("path")), "/media/in")


@query(f"""WITH {_ACTIONS}, q AS (SELECT project, CASE project % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 1000 END::BIGINT AS asked, max(revision) AS head FROM h GROUP BY project), w AS (SELECT project, coalesce(asked, head) AS revision FROM q)
  SELECT w.project, w.revision, CASE WHEN snapshot_hash <> 'bad' THEN snapshot END AS snapshot, CASE WHEN snapshot IS NULL THEN 'missing' WHEN snapshot_hash <> 'bad' THEN 'ok' ELSE 'damaged' END AS state FROM w LEFT JOIN h ON h.project = w.project AND h.revision = w.revision""")
def src1_snapshots(spark, sf_dir):
    """Projects at their head or at a revision asked for, their checksums verified."""
    own = _history(spark, sf_dir)
    p = F.col("project")
    asked = own.select("project").distinct().withColumn("revision", F.when(p % 3 == 1, 1).when(p % 3 == 2, 1000).cast("long"))
    return tr.snapshots_at(own, asked)


@query(f"""WITH {_ACTIONS}, r AS (SELECT project, revision, snapshot, CASE WHEN snapshot_hash <> 'bad' THEN 'ok' ELSE 'damaged' END AS state FROM h), asked AS (SELECT c_custkey AS project, c_nationkey::BIGINT AS revision FROM customer)
  SELECT asked.project, asked.revision, CASE WHEN state = 'ok' THEN snapshot END AS snapshot, coalesce(state, 'missing') AS state FROM asked LEFT JOIN r USING (project, revision)""")
def src7_references(spark, sf_dir):
    """References by project and revision, resolved against the saved ones."""
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").cast("long").alias("revision"))
    return tr.snapshots_at(_history(spark, sf_dir), asked)


@query("""WITH f AS (SELECT 'in/' || CASE doc_id % 6 WHEN 0 THEN '.state/' WHEN 1 THEN '.state-1/' WHEN 2 THEN 'a/b/' ELSE '' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mkv' WHEN 2 THEN '.tar.wav' ELSE '' END AS path, length(text) AS bytes FROM documents),
  o AS (SELECT substr(path, 4) AS path, bytes FROM f WHERE path NOT LIKE 'in/.state%' AND lower(path) LIKE '%.wav')
  SELECT path, bytes, (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM o) > 20 AS truncated FROM o ORDER BY path LIMIT 20""")
def src2_folder(spark, sf_dir):
    """The first twenty sound files of a folder by path, and how many there are."""
    n, name = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = F.when(n % 6 == 0, ".state/").when(n % 6 == 1, ".state-1/").when(n % 6 == 2, "a/b/").otherwise("")
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), folder, name, F.when(n % 4 == 0, ".WAV").when(n % 4 == 1, ".mkv").when(n % 4 == 2, ".tar.wav").otherwise("")).alias("path"), F.length("text").cast("long").alias("length"))
    return tr.listing(files, "in", ["wav"], ".state", 20)
