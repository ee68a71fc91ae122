"""Track edits, links, attributes, pages, snapshots, words, scalars and streams on fixed cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from splicework.functions import scalars as sc
from splicework.operators import edits, grading, language, picks, snapshots, tables
from splicework.operators import tracks as tr
from splicework.streaming import power

CLIPS = "track long, id long, start long, stop long, source_in long"


def rows(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=repr)


def test_trim_remove_append(spark):
    seq = spark.createDataFrame([(1, 1, 5, 0), (1, 2, 5, 0)], "track long, id long, n long, source_in long").withColumn("o", F.col("id"))
    trims = spark.createDataFrame([(1, 1, 2, 3)], "track long, id long, new_in long, new_length long")
    assert rows(tr.trimmed(seq, trims, ["track"], "o", "n"), "id", "start", "stop", "source_in") == [(1, 0, 3, 2), (2, 3, 8, 0)]
    left = tr.removed(seq, seq.where("id = 1"), ["track"])
    more = spark.createDataFrame([(1, 9, 7, 4, 1)], "track long, id long, n long, source_in long, o long")
    assert rows(tr.appended(left, more, ["track"], "o"), "id", "o") == [(2, 1), (9, 2)]


def test_moves_replace_what_they_meet_and_refuse_one_another(spark):
    clips = spark.createDataFrame([(1, 1, 0, 10, 0), (1, 2, 20, 30, 0), (2, 3, 0, 10, 0), (2, 4, 40, 50, 0)], CLIPS)
    moves = spark.createDataFrame([(1, 1, 15, None), (2, 3, 2, 3), (2, 4, -38, 3)], "track long, id long, shift long, target long")
    got, clash = tr.moved(clips, moves, ["track"], 100)
    assert rows(clash) == [(3, 3, 4)] and rows(got, "track", "id", "start") == [(1, 1, 15), (2, 3, 0), (2, 4, 40)]


def test_links(spark):
    links = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (2, 3, 0, 0), (2, 4, 0, 0)], "link long, clip long, start long, source_in long")
    clips = spark.createDataFrame([(1, i, 10 * i, 10 * i + 5, 7) for i in range(1, 7)], CLIPS)
    assert rows(tr.with_partners(spark.createDataFrame([(1,), (5,)], "clip long"), links)) == [(1,), (2,), (5,)]
    chosen = spark.createDataFrame([(7, 5), (7, 6), (8, 3), (9, 3), (9, 4)], "link long, clip long")
    got = tr.relinked(links, clips, spark.createDataFrame([(1,)], "link long"), chosen)
    assert rows(got, "link", "clip") == [(2, 3), (2, 4), (7, 5), (7, 6), (9, 3), (9, 4)]
    parts = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0)], "clip long, part int")
    assert rows(tr.links_of_parts(links.select("link", "clip"), parts)) == [(1, 0, 1, True), (1, 0, 2, True), (1, 1, 1, True), (1, 1, 2, True), (2, 0, 3, False), (2, 0, 4, False), (2, 1, 3, False)]


def test_fades_of_parts(spark):
    clips = spark.createDataFrame([(1, 1, 0, 100, 0)], CLIPS).withColumns({"fade_in": F.lit(10), "fade_out": F.lit(20)})
    pieces = spark.createDataFrame([(1, 1, 0, 50), (1, 1, 50, 100), (1, 1, 5, 60), (1, 1, 50, 90)], "track long, id long, start long, stop long")
    assert rows(tr.faded_parts(pieces, clips, ["track"]), "start", "stop", "fade_in", "fade_out", "inside") == [(0, 50, 10, 0, False), (5, 60, 0, 0, True), (50, 100, 0, 20, False), (50, 90, 0, 0, True)]


def test_upserts(spark):
    own = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 7, "c")], "k long, x long, y string")
    changes = spark.createDataFrame([(1, None, "z", False), (3, 1, None, True), (4, 9, "n", False)], "k long, x long, y string, _drop boolean")
    assert rows(tr.upserted(own, changes, ["k"])) == [(1, 5, "z"), (2, 6, "b"), (4, 9, "n")]


def test_curves_pages_and_lists(spark):
    keys = spark.createDataFrame([(1, 1, 1, 2, 5), (1, 2, 2, 4, 500), (1, 3, 9, 2, 5), (1, 4, 1, 2_000_003, 5), (2, 1, 0, 1, 0)], "curve long, index long, num long, den long, value long").withColumns({"end_num": F.lit(4), "end_den": F.lit(1)})
    assert rows(tr.curve_issues(keys, ["curve"], 0, 100, 3)) == [(1, 2, "equal"), (1, 2, "range"), (1, 3, "late"), (1, 4, "coarse"), (1, None, "count")]
    own = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "k long, v long")
    assert rows(tr.page(own, ["k"], ["v"], 2, 2)) == [(1, 2, 5, 4), (1, 3, 5, 4)] and rows(tr.page(own, ["k"], ["v"], 4, 2)) == [(1, 4, 5, None)]
    assert rows(tr.listed(own, ["k"], ["v"], "v", 2)) == [(1, [0, 1], 5), (2, [0], 1)]


def test_snapshots_and_listing(spark):
    good = "ab"
    revisions = spark.createDataFrame([(1, 0, good), (1, 1, good)], "project long, revision long, snapshot string").withColumn("snapshot_hash", F.when(F.col("revision") == 0, F.sha2("snapshot", 256)).otherwise("x"))
    asked = spark.createDataFrame([(1, 0), (1, None), (1, 7), (2, None)], "project long, revision long")
    assert rows(tr.snapshots_at(revisions, asked), "project", "revision", "snapshot", "state") == [(1, 0, "ab", "ok"), (1, 1, None, "damaged"), (1, 7, None, "missing"), (2, None, None, "missing")]
    files = spark.createDataFrame([("in/b.WAV", 1), ("in/a/c.wav", 2), ("in/.s/d.wav", 3), ("in/.s-1/e.wav", 4), ("in/f.txt", 5), ("out/g.wav", 6), ("in/wav", 7)], "path string, length long")
    assert rows(tr.listing(files, "in/", [".wav"], ".s", 1)) == [("a/c.wav", 2, 2, True)]
    assert rows(tr.listing(files, "in", [], ".s", 9, recursive=False), "path", "total") == [("b.WAV", 3), ("f.txt", 3), ("wav", 3)]


def test_fresh_ids_and_reach(spark):
    own = spark.createDataFrame([(1, n) for n in range(3)], "track long, n long")
    used = spark.createDataFrame([(1, f"c-j{j}") for j in (1, 2, 3, 4)] + [(1, "d-j9")], "track long, id string")
    assert rows(edits.fresh_ids(own, used, ["track"], "n", F.lit("c")), "n", "fresh") == [(0, "c-j5"), (1, "c-j6"), (2, "c-j7")]
    members = spark.createDataFrame([(i, j) for i in range(12) for j in (i, i + 1)], "track long, link long")
    assert len(snapshots.reached(members, members.where("track = 0"), "track", "link").collect()) == 12
    assert edits.applied(own, [lambda d: d.withColumn("n", F.col("n") + 1)] * 45, lambda d: d.where("n > 99")).agg(F.sum("n")).first()[0] == 138


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("colour", "color", True), ("realise", "realize", True), ("centre", "center", True), ("dialogue", "dialog", True), ("defence", "defense", True), ("travelled", "traveled", True), ("grey", "gray", True), ("cheques", "checks", True), ("judgement", "judgment", True), ("colour", "colour", False), ("four", "for", False), ("prise", "prize", False), ("walked", "waked", False)],
)
def test_spellings(spark, a, b, same):
    got = spark.createDataFrame([(a, b), (b, a)], "a string, b string").select(language.variants("a", "b")).collect()
    assert [r[0] for r in got] == [same, same]


def test_spoken_numbers(spark):
    cases = {
        "80": "eighty", "170": "one hundred seventy", "1,500": "one thousand five hundred", "1,000,000": "one million", "0": "zero", "007": "zero zero seven", "3.5": "three point five", "3.14": "three point one four",
        "21st": "twenty first", "11th": "eleventh", "12th": "twelfth", "100th": "one hundredth", "20th": "twentieth", "2ND": "second", "1990": "nineteen ninety", "1905": "nineteen oh five", "1900": "nineteen hundred",
        "2010": "twenty ten", "2026": "twenty twenty six", "2000": "two thousand", "2005": "two thousand five", "2100": "two thousand one hundred", "1990s": "nineteen nineties", "80's": "eighties", "$5": "five dollars", "$3.50": "three dollars fifty cents",
        "50%": "fifty percent", "-4": "minus four", "1,000th": "one thousandth", "word": None, "12,34": None,
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", language.spoken(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_transcripts(spark):
    w = spark.createDataFrame([(1, i, i, f"w{i}", 10 * i, 10 * i + 8) for i in range(4)], "asset long, id long, pos long, text string, start long, stop long")
    e = spark.createDataFrame([(1, "replace", 1, "new", 10, 18, None), (1, "remove", 2, None, None, None, None), (1, "insert", 9, "in", 8, 10, 1), (1, "insert", 3, "there", 0, 1, None), (1, "replace", 77, "x", 0, 1, None)], "asset long, op string, id long, text string, start long, stop long, before_id long")
    assert [r[1] for r in sorted(rows(language.corrected(w, e), "pos", "text"))] == ["w0", "in", "new", "w3"]
    cut = spark.createDataFrame([(1, 10, 18)], "asset long, offset long, length long")
    assert rows(language.rebound(w, cut), "id", "start", "stop") == [(1, 0, 8), (2, 10, 18)]
    words = w.withColumnRenamed("text", "word")
    assert rows(language.removals(words, F.col("pos").isin(1, 2), ["asset"], "pos", 5)) == [(1, 8, 30, 2)]
    plan = language.fingerprints(words)
    cuts = spark.createDataFrame([(1, 4, 12)], "asset long, start long, stop long")
    assert rows(language.cut_plan(words, cuts, plan, "asset", 100), "pos", "start", "stop") == [(0, 0, 4), (1, 12, 18), (2, 20, 28), (3, 30, 38)]
    assert language.cut_plan(words.where("pos < 3"), cuts, plan, "asset", 100).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    pair = lambda t: (lambda r: r and tuple(r))(one(sc.literal(F.lit(t))))
    assert [pair(t) for t in ("5/2", "10/4", "2.5", "3", "0.100", "1/0", "-1", "1e5", "1.", "9007199254740993", "0.0000000000000000001")] == [(5, 2), (5, 2), (5, 2), (3, 1), (1, 10), None, None, None, None, None, None]
    assert one(sc.display(F.lit(98), F.lit(50))) == "49/25" and one(sc.display(F.lit(6), F.lit(2))) == "3"
    assert one(sc.label(F.lit(1), F.lit("01:02:03:04"))) == (86_400 + 3_723) * 25 + 4 and one(sc.label(F.lit(0), F.lit("24:00:00:00"))) is None
    for curve in ("bt709", "srgb", "pq", "hlg"):
        assert all(one(sc.encoded(sc.decoded(F.lit(x), curve), curve)) == pytest.approx(x, abs=1e-5) for x in (0.01, 0.3, 0.6, 1.0))
    assert one(sc.within(F.lit("a\\b"), F.lit("a"))) and not one(sc.within(F.lit("ab"), F.lit("a")))
    assert one(sc.slug(F.lit(" Été, 2 Takes! "))) == "t-2-takes"


def test_peaks_against_brute_force(spark):
    rng = random.Random(3)
    points = [(k, i, rng.randrange(50)) for k in range(3) for i in range(400)]
    got = rows(picks.peaks(spark.createDataFrame(points, "k long, i long, s long"), ["k"], "i", "s", 6, 20), "k", "i")
    want = []
    for k in range(3):
        kept = []
        for _, i in sorted((-s, i) for x, i, s in points if x == k):
            if len(kept) < 6 and all(abs(i - j) >= 20 for j in kept):
                kept.append(i)
        want += [(k, i) for i in kept]
    assert got == sorted(want, key=repr)


def test_published_tables_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.published(spark.range(3), path).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.published(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_streams(spark, tmp_path):
    """Strict gaps, sliding windows, state over batches, and requests that are sent again."""
    (tmp_path / "in").mkdir()
    schema = "track long, ts timestamp, length long, value double"
    for n, times in enumerate([[0, 10, 25], [100, 100_000]]):
        own = spark.createDataFrame([(1, t) for t in times], "track long, s long").select("track", F.timestamp_seconds("s").alias("ts"), F.lit(5_000).cast("long").alias("length"), F.lit(2.0).alias("value"))
        own.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name, write=None):
        out = str(tmp_path / name)
        w = df.writeStream.outputMode(mode).option("checkpointLocation", out + "-state").trigger(availableNow=True)
        (w.foreachBatch(write(out)) if write else w.format("parquet").option("path", out)).start().awaitTermination()
        return spark.read.parquet(out)

    got = run(power.regions(stream, "track", "ts", "length", 5_000, "10 seconds"), "append", "regions")
    # the second begins exactly the bridge behind the first's end: they stay apart
    assert rows(got.select(F.unix_seconds("start").alias("a"), F.unix_seconds("stop").alias("z"), "n")) == [(0, 5, 1), (10, 15, 1), (100, 105, 1), (25, 30, 1)]
    slid = run(power.sliding_power(stream, "track", "ts", "value", "20 seconds", "10 seconds", "10 seconds"), "append", "sliding")
    assert rows(slid.where("n = 2").select(F.unix_seconds("start").alias("a"), "power")) == [(0, 8.0), (10, 8.0)]
    meter = run(power.metered(stream, "track", "value"), "update", "meter", lambda out: lambda b, n: b.write.mode("append").parquet(out))
    assert max(rows(meter, "n", "power", "peak")) == (5, 20.0, 2.0)
    write = power.once(str(tmp_path / "once"), ["track"])
    for number, ids in ((0, [1, 2, 2]), (1, [2, 3]), (1, [2, 3]), (2, [1])):
        write(spark.createDataFrame([(i,) for i in ids], "track long"), number)
    assert rows(spark.read.parquet(str(tmp_path / "once")).select("track")) == [(1,), (2,), (3,)]


def test_masks_and_grades(spark):
    p = spark.createDataFrame([(x, y) for x in range(12) for y in range(8)], "x long, y long")

    def brute(x, y, rect, radius, edge, inverted):
        left, top, width, height = rect
        d = min(x + 0.5 - left, left + width - x - 0.5, y + 0.5 - top, top + height - y - 0.5)
        if radius:
            lo, hi = {"inner": (0, radius), "centered": (-radius, radius), "outer": (-radius, 0)}[edge]
            w = math.floor(65_536 * min(1, max(0, (d - lo) / (hi - lo))) + 0.5)
        else:
            w = 65_536 if d > 0 else 0
        return 65_536 - w if inverted else w

    for radius, edge, inverted in ((0, "inner", False), (2, "inner", False), (2, "centered", True), (3, "outer", False)):
        got = p.select("x", "y", grading.coverage(F.col("x"), F.col("y"), (3, 2, 6, 4), radius, edge, inverted).alias("w")).collect()
        assert all(r["w"] == brute(r["x"], r["y"], (3, 2, 6, 4), radius, edge, inverted) for r in got)
    pixels = spark.createDataFrame([(v, v, 255 - v) for v in range(256)], "r long, g long, b long")
    assert rows(grading.graded(pixels, 0.0, 1.0, (1.0, 1.0, 1.0))) == rows(pixels)
    assert rows(grading.graded(pixels, 3.0, 2.0, (1.0, 0.5, 0.2), F.lit(0.0))) == rows(pixels)
    flat = spark.createDataFrame([(1, 7)] * 3, "k long, v long")
    other = spark.createDataFrame([(1, 10), (1, 30)], "k long, v long")
    assert rows(grading.levels_match(flat, other, ["k"], "v")) == [(1, 7, 20)]


def test_nearest_scaling_and_frame_index(spark):
    p = spark.createDataFrame([(1, x, y, 10 * x + y, 0, 0) for x in range(4) for y in range(2)], "k long, x long, y long, r long, g long, b long")
    same = grading.scaled_nearest(p, ["k"], (4, 2), (4, 2))
    assert rows(same.select(*p.columns)) == rows(p)
    assert rows(grading.scaled_nearest(p, ["k"], (4, 2), (2, 1)), "x", "y", "r") == [(0, 0, 11), (1, 0, 31)]
    packets = spark.createDataFrame([(1, 1, 0, False, 5), (1, 2, 40, True, 6), (1, 3, 40, False, 7), (1, 4, 90, False, 8)], "k long, id long, pts long, key_frame boolean, samples long")
    assert rows(picks.frame_index(packets, ["k"]), "frame", "length", "anchor", "samples_before") == [(0, 40, None, 0), (1, 0, 1, 5), (2, 50, 1, 11), (3, None, 1, 18)]


def test_regions_count_whole_milliseconds(spark, tmp_path):
    """The first track's neighbours are 9,999.7 ms apart, but 9,999 in whole milliseconds: within length and bridge."""
    first = [(1, 200), (1, 40_000_000), (2, 900), (2, 40_000_000)]
    own = spark.createDataFrame(first + [(1, 9_999_900), (2, 10_000_100)], "track long, us long").select("track", F.timestamp_micros("us").alias("ts"), F.lit(5_000).cast("long").alias("length"))
    own.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track long, ts timestamp, length long").parquet(str(tmp_path / "in"))
    w = power.regions(stream, "track", "ts", "length", 5_000, "1 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    w.trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("track", F.unix_millis("start").alias("a"), F.unix_millis("stop").alias("z"), "n")
    assert rows(got) == [(1, 0, 14_999, 2), (2, 0, 5_000, 1), (2, 10_000, 15_000, 1)]  # the last of each is still open
