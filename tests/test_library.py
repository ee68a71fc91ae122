"""The library's queries against their SQL, and properties of its operators."""

from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from splicework.functions import rational
from splicework.operators import intervals as iv
from splicework.operators import edits, ordered, signals, transcripts
from splicework.plans.catalog import ORACLES, QUERIES
from splicework.sources import captions
from splicework.streaming import power

SF = "/root/testdata/sf0.001"


def rows_of(records, columns):
    cell = lambda x: float(x) if isinstance(x, float) else x
    return sorted((tuple(cell(r[c]) for c in columns) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    db = duckdb.connect()
    for p in Path(SF).iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = rows_of([r.asDict() for r in got.collect()], columns)
    b = rows_of([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)
    assert len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.fixture
def clips(spark):
    rows = [("t", 1, 0, 10, 5), ("t", 2, 10, 20, 0), ("t", 3, 30, 35, 7), ("u", 4, 0, 5, 0)]
    return spark.createDataFrame(rows, "track string, id long, start long, stop long, source_in long")


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_touching_is_not_overlapping(clips):
    assert found(iv.collisions(clips, ["track"], 4), "id") == []
    assert found(iv.merged(clips, ["track"]), "track", "start", "stop", "members") == [("t", 0, 20, 2), ("t", 30, 35, 1), ("u", 0, 5, 1)]
    assert found(iv.most_at_once(clips, ["track"]), "track", "most") == [("t", 1), ("u", 1)]


def test_bridge_is_strict(clips):
    assert iv.merged(clips.where("track = 't'"), ["track"], 10).count() == 2
    assert iv.merged(clips.where("track = 't'"), ["track"], 11).count() == 1


def test_holes_have_head_and_tail(clips):
    assert found(iv.holes(clips, ["track"], F.lit(-3), F.lit(40)), "track", "start", "stop") == [("t", -3, 0), ("t", 20, 30), ("t", 35, 40), ("u", -3, 0), ("u", 5, 40)]


def test_ripple_closes_cuts(spark, clips):
    cuts = spark.createDataFrame([("t", 4, 12), ("t", 11, 14), ("u", 7, 9)], "track string, start long, stop long")
    got = iv.rippled(clips, cuts, ["track"], 4)
    assert found(got, "id", "start", "stop", "source_in") == [(1, 0, 4, 5), (2, 4, 10, 4), (3, 20, 25, 7), (4, 0, 5, 0)]


def test_split_insert_and_roll(clips):
    assert found(iv.inserted(clips, F.lit(15), 100).where("id = 2"), "start", "stop", "source_in", "part") == [(10, 15, 0, 0), (115, 120, 5, 1)]
    assert found(iv.rolled(clips, ["track"], F.lit(1), 2).where("id < 3"), "id", "start", "stop", "source_in") == [(1, 0, 12, 5), (2, 12, 20, 2)]
    assert found(iv.rolled(clips, ["track"], F.lit(2), 2), "id", "start") == found(clips, "id", "start")  # the next clip does not touch


def test_operators_on_empty_tables(clips):
    none = clips.where("false")
    for df in (iv.merged(none, ["track"]), iv.holes(none, ["track"], F.lit(0), F.lit(1)), iv.subtracted(none, none, ["track"], 5), iv.segments(none, ["track"], 5), ordered.spaced(none, ["track"], "start", 3)):
        assert df.count() == 0


def test_spacing_is_greedy(spark):
    rows = spark.createDataFrame([("k", x) for x in (0, 4, 5, 9, 10, 30)], "k string, at long")
    assert found(ordered.spaced(rows, ["k"], "at", 5), "at") == [(0,), (5,), (10,), (30,)]


def test_rationals_are_exact(spark):
    cases = [(1, 2, 1, 3), (2, 4, 1, 2), (100_000 * 1001, 30_000, 1, 48_000), (2**53 - 1, 2, 3, 2**53 - 1), (0, 7, 5, 9)]
    df = spark.createDataFrame(cases, "a long, b long, c long, d long")
    x, y = (F.struct(F.col(n).alias("num"), F.col(m).alias("den")) for n, m in (("a", "b"), ("c", "d")))
    for r in df.select("*", rational.less(x, y).alias("less"), rational.equal(x, y).alias("same"), rational.make(F.col("a"), F.col("b")).alias("low"), rational.ticks(x, F.struct(F.lit(30_000).alias("num"), F.lit(1001).alias("den"))).alias("t")).collect():
        p, q = Fraction(r["a"], r["b"]), Fraction(r["c"], r["d"])
        ticks = p * Fraction(30_000, 1001)
        assert (r["less"], r["same"]) == (p < q, p == q) and (r["low"]["num"], r["low"]["den"]) == (p.numerator, p.denominator)
        assert r["t"] == (ticks.numerator if ticks.denominator == 1 else None)


def test_srt_edges(spark):
    text = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nfirst\r\nline\r\n\r\nnot a cue\r\n\r\n2\r\n01:00:00.001 --> 01:00:00.002 X1:0\r\nü\r\n"
    cues = captions.parse_srt(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t")
    assert found(cues, "cue", "start", "stop", "text") == [(1, 1500, 2000, "first\nline"), (2, 3_600_001, 3_600_002, "ü")]


def test_streaming_power_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = power.tumbling_power(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "value", "10 minutes", "1 day")
    q = stream.writeStream.format("memory").queryName("power").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.groupBy("user_id", F.window("ts", "10 minutes")).count().count()
    assert spark.table("power").count() == batch


def test_shots_need_twice_their_neighbours_and_room(spark):
    d = [0, 1, 9, 1, 1, 9, 5, 1, 9, 9, 1, 1, 30, 1, 8]
    rows = spark.createDataFrame([("t", i, float(x)) for i, x in enumerate(d)], "track string, k long, d double")

    def brute(apart):
        kept = [0]
        for i in range(1, len(d)):
            near = max([d[m] for m in (i - 2, i - 1, i + 1, i + 2) if 1 <= m < len(d)], default=0)
            if d[i] >= 8 and d[i] >= 2 * near and i - kept[-1] >= apart:
                kept.append(i)
        return kept

    for apart in (1, 3, 5):
        assert [k for (k,) in found(signals.shot_cuts(rows, ["track"], "k", "d", 8.0, apart), "k")] == brute(apart)


def test_cues_break_at_pauses_sentences_length_and_lines(spark):
    said = [("one", 0, 10), ("two.", 10, 20), ("three", 20, 30), ("four", 90, 100), ("abcdefgh", 100, 110), ("ij", 110, 120), ("klmno", 120, 130), ("p", 130, 140)]
    rows = spark.createDataFrame([("a", i, *w) for i, w in enumerate(said)], "asset string, pos long, word string, start long, stop long")
    texts = [t for _, t in found(transcripts.cues(rows, ["asset"], 30, 1_000, 8, 2), "cue", "text")]
    assert texts == ["one two.", "three", "four abcdefgh", "ij klmno p"]
    assert [t for _, t in found(transcripts.cues(rows, ["asset"], 30, 25, 80, 2), "cue", "text")] == ["one two.", "three", "four abcdefgh", "ij klmno", "p"]


def test_curve_against_fractions(spark):
    keys = [(0, 10, "linear"), (3, -5, "ease_in"), (7, 8, "ease_out"), (12, 1, "ease_in_out"), (19, 90, "hold"), (21, 4, "linear")]
    curve = spark.createDataFrame([("t", *k) for k in keys], "track string, at long, value long, mode string")
    points = spark.createDataFrame([("t", i) for i in range(-2, 25)], "track string, at long")

    def brute(t):
        if t <= 0 or t >= 21:
            return 10 if t <= 0 else 4
        (a, u, mode), (b, v, _) = next((x, y) for x, y in zip(keys, keys[1:], strict=False) if x[0] <= t < y[0])
        x = Fraction(t - a, b - a)
        x = {"hold": 0, "linear": x, "ease_in": x * x, "ease_out": 1 - (1 - x) ** 2, "ease_in_out": 2 * x * x if x <= Fraction(1, 2) else 1 - 2 * (1 - x) ** 2}[mode]
        y = u + (v - u) * x
        return int(abs(y) + Fraction(1, 2)) * (1 if y >= 0 else -1)

    assert found(edits.sampled(points, curve, ["track"]), "at", "value") == [(t, brute(t)) for t in range(-2, 25)]


@pytest.mark.parametrize("text, so", [("um", True), ("UHM", True), ("hmm", True), ("m", True), ("a", True), ("ummmm", False), ("h", False), ("the", False), ("", False)])
def test_hesitations(spark, text, so):
    assert spark.range(1).select(transcripts.filler_like(F.lit(text))).first()[0] is so


def test_a_slip_before_the_source_fails(clips):
    with pytest.raises(Exception, match="slip before"):
        edits.slipped(clips, F.lit(True), -6).collect()
