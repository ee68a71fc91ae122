"""Clocks, checks, exchange documents, sound and pixels against brute force and fixed cases."""

import hashlib
import json
import random
from fractions import Fraction
from math import log

import pytest
from pyspark.sql import functions as F

from splicework.operators import checks, clocks, pixels, signals, sound, transcripts
from splicework.sources import captions, media, otio


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_speed_maps_are_exact(spark):
    segments = [(1, 10, 500, 2000, False), (2, 7, 2000, 0, False), (3, 5, 1000, 3000, True)]
    seg = spark.createDataFrame([("t", *s) for s in segments], "track string, n long, length long, rate_a long, rate_b long, reverse boolean")
    points = spark.createDataFrame([("t", i) for i in range(-1, 25)] + [("none", 1)], "track string, at long")

    def brute(t):
        source = Fraction(0)
        for i, (_, n, a, b, back) in enumerate(segments):
            own = min(t, n)
            way = (Fraction(a) * own + Fraction(b - a, n) * own * own / 2) / 1000
            source += -way if back else way
            if t < n or (i == len(segments) - 1 and t == n):
                return source
            t -= n
        return None

    got = {(r["track"], r["at"]): r["num"] if r["num"] is None else Fraction(r["num"], r["den"]) for r in clocks.source_times(points, seg, ["track"], "n").collect()}
    assert got == {("t", t): None if t < 0 else brute(t) for t in range(-1, 25)} | {("none", 1): None}


@pytest.mark.parametrize("end, want", [("loop", [1, 1, 2, 1, 1]), ("hold", [1, 1, 2, 2, 2]), ("transparent", [1, 1, 2, None, None])])
def test_holds_end(spark, end, want):
    holds = spark.createDataFrame([("t", 1, 2), ("t", 2, 1)], "track string, n long, hold long")
    points = spark.createDataFrame([("t", i) for i in range(5)], "track string, at long")
    assert [f for _, f in found(clocks.held_frames(points, holds, ["track"], "n", end), "at", "frame")] == want


def test_windows_hold_as_many_clips_as_fit(spark):
    rng = random.Random(5)
    rows = [(f"k{k}", a, a + rng.randint(0, 30)) for k in range(3) for a in (rng.randint(0, 400) for _ in range(60))]
    got = clocks.windows_of(spark.createDataFrame(rows, "track string, start long, stop long"), ["track"], 2, 9).collect()
    for k in ("k0", "k1", "k2"):
        own = [(a, z) for t, a, z in rows if t == k and a < z]
        held = lambda a, z: sum(s < z and a < e for s, e in own)  # noqa: B023, E731
        mine = sorted((r["start"], r["stop"], r["clips"]) for r in got if r["track"] == k)
        end = max(z for _, z in own)
        assert mine[0][0] == min(a for a, _ in own) and mine[-1][1] == end and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
        assert all(held(a, z) == n <= 9 and (z == end or ((z - a) % 2 == 0 and held(a, z + 2) > 9)) for a, z, n in mine)


def test_a_step_with_more_clips_is_a_stretch_of_its_own(spark):
    rows = [("a", 0, 1)] + [("a", 10 + k % 2, 30) for k in range(4)] + [("b", 5, 9)]
    got = clocks.windows_of(spark.createDataFrame(rows, "track string, start long, stop long"), ["track"], 6, 2)
    assert found(got, "track", "start", "stop", "clips") == [("a", 0, 6, 1), ("a", 6, 12, 4), ("a", 12, 18, 4), ("a", 18, 24, 4), ("a", 24, 30, 4), ("b", 5, 9, 1)]


def test_undo_is_a_stack(spark):
    rng, rows, want = random.Random(3), [], []
    for p in range(5):
        stacks = []  # what each revision can be undone to, in turn
        for r in range(30):
            action = "create" if r == 0 else rng.choice(["apply", "undo", "undo", "restore"])
            old = rng.randrange(r) if action == "restore" else None
            if action == "undo":
                before = stacks[-1]
                restored, own = (before[-1], stacks[before[-1]]) if before else (None, ())
            else:
                restored, own = old, () if r == 0 else (*stacks[-1], r - 1)
            stacks.append(own)
            rows.append((p, r, action, old))
            want.append((p, r, restored, own[-1] if own else None))
    got = checks.undo_pointers(spark.createDataFrame(rows, "project long, revision long, action string, restored_from long"), "project")
    assert sorted(map(tuple, got.select("project", "revision", "restored_from", "undo_target").collect())) == want


def test_a_sound_history_has_no_issue_and_a_broken_one_has(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    good = [(0, None, "create", None, None, "a"), (1, 0, "apply", 0, None, "b"), (2, 1, "undo", None, 0, "a"), (3, 2, "restore", 2, 1, "b")]
    shape = "project long, revision long, parent long, action string, undo_target long, restored_from long, snapshot string, snapshot_hash string"
    frame = lambda rows: spark.createDataFrame([(1, *r, sha(r[-1])) for r in rows], shape)
    assert checks.history(frame(good), "project").count() == 0
    assert found(checks.history(frame([good[0], good[2], (4, 3, "paint", 3, None, "x")]), "project"), "revision", "issue") == [(2, "gap"), (2, "undo"), (4, "action"), (4, "gap")]  # revision 2 follows one without a pointer
    bad = [good[0], good[1], (2, 1, "undo", None, 1, "b"), (3, 2, "restore", 2, 0, "b")]
    assert found(checks.history(frame(bad), "project"), "revision", "issue") == [(2, "undo"), (3, "content")]


def test_limiter_against_the_fold(spark):
    rng = random.Random(1)
    peaks = [rng.choice([0, 10, 900, 1500, 5000]) for _ in range(200)]
    one, ahead, step, ceiling = sound.ONE, 5, 2**28, 1000
    need = [one if p <= ceiling else ceiling * one // p for p in peaks]
    rise, want = [], []
    for i in range(len(peaks)):
        rise.append(min(min(need[max(0, i - ahead) : i + 1]), min(one, (rise[-1] if rise else one) + step)))
        near = rise[max(0, i - ahead) :]
        want.append((sum(near) + (ahead + 1 - len(near)) * one) // (ahead + 1))
    rows = spark.createDataFrame([("t", i, p) for i, p in enumerate(peaks)], "track string, k long, p long")
    assert [g for _, g in found(sound.limited(rows, ["track"], "k", "p", ceiling, ahead, step), "k", "gain")] == want


def test_beats_are_the_best_chain(spark):
    rng = random.Random(4)
    s, p = [rng.random() for _ in range(14)], 3
    mean = sum(s) / len(s)
    deviation = (sum((x - mean) ** 2 for x in s) / len(s)) ** 0.5

    def worth(chain):
        return sum(s[t] / deviation for t in chain) - sum(2 * log((b - a) / p) ** 2 for a, b in zip(chain, chain[1:], strict=False))

    def chains(at):
        yield [at]
        for d in range(2, 7):
            if at - d >= 0:
                yield from ([*c, at] for c in chains(at - d))

    best = max((c for at in range(len(s) - p, len(s)) for c in chains(at)), key=worth)
    rows = spark.createDataFrame([("t", i, x, p) for i, x in enumerate(s)], "track string, k long, s double, p long")
    assert [k for (k,) in found(sound.beats(rows, ["track"], "k", "s", "p", 2.0), "k")] == best
    assert sound.beats(rows.withColumn("s", F.lit(1.0)), ["track"], "k", "s", "p", 2.0).count() == 0


def test_sync_finds_a_planted_delay(spark):
    rng = random.Random(2)
    a = [rng.randint(-100, 100) for _ in range(300)]
    rows = spark.createDataFrame([("t", i, x, a[i - 4] if i >= 4 else 0) for i, x in enumerate(a)] + [("silent", i, 0, 0) for i in range(9)], "track string, k long, a long, b long")
    best = sound.separated(sound.correlated(rows, ["track"], "k", "a", "b", range(-8, 9)), ["track"], "lag", "score", 2, 0.2)
    assert found(best, "track", "lag", "sure") == [("t", 4, True)]


def test_crop_path_stays_within_bounds_and_steps(spark):
    rows = [(0, 0, 10, 9), (1, 0, 10, 9), (2, 0, 3, 9), (3, 0, 10, 9), (4, 6, 10, 0)]
    df = spark.createDataFrame([("t", *r) for r in rows], "track string, k long, low long, high long, target long")
    assert found(pixels.crop_path(df, ["track"], "k", "low", "high", "target", 3), "k", "at") == [(0, 9), (1, 6), (2, 3), (3, 6), (4, 6)]
    with pytest.raises(Exception, match="no path"):
        pixels.crop_path(df, ["track"], "k", "low", "high", "target", 1).collect()


def test_documents_carry_gaps_and_report_losses(spark):
    clips = spark.createDataFrame([("d", 0, "Video", "a", "u/a", 5, 10, 20), ("d", 0, "Video", "b", None, 0, 20, 25), ("d", 1, "Audio", "c", "u/c", 1, 0, 4)], "doc string, lane int, kind string, name string, url string, source_in long, start long, stop long")
    out = otio.exported(clips, ["doc"], "lane", 25)
    text = json.loads(out.first()["otio"])
    assert [c["OTIO_SCHEMA"] for c in text["tracks"]["children"][0]["children"]] == ["Gap.1", "Clip.1", "Clip.1"]
    assert found(otio.imported(out, "doc", "otio", 25), "name", "kind", "track", "ordinal", "source_in", "start", "stop") == [("a", "Video", 0, 1, 5, 10, 20), ("b", "Video", 0, 2, 0, 20, 25), ("c", "Audio", 1, 0, 1, 0, 4)]
    text["tracks"]["children"][0]["children"][1] |= {"OTIO_SCHEMA": "Transition.1"}
    text["tracks"]["children"][1]["children"][0]["source_range"]["duration"]["value"] = 0.3
    odd = spark.createDataFrame([("d", json.dumps(text)), ("e", "{"), ("f", None), ("g", '{"OTIO_SCHEMA": "Clip.1"}')], "doc string, otio string")
    assert found(otio.losses(odd, "doc", "otio", 25), "doc", "track", "ordinal", "loss") == [("d", 0, 1, "Transition"), ("d", 1, 0, "time")]


def test_webvtt_edges(spark):
    text = "﻿WEBVTT - title\r\n\r\nSTYLE\r\n::cue {}\r\n\r\nNOTE 00:00.000 --> 00:01.000\r\nno\r\n\r\nid\r\n01:02.003 --> 01:00:00.000 align:start\r\n<v.loud Ann B>Hi <i>you</i> &amp;lt;\r\nthere\r\n\r\n00:00.000 --> 00:00.001\r\n&lt;x&gt;"
    files = spark.createDataFrame([(1, text), (2, "no\n\n00:00.000 --> 00:01.000\nx"), (3, None), (4, "WEBVTT")], "id long, t string")
    assert found(captions.parse_vtt(files, "id", "t"), "id", "cue", "start", "stop", "speaker", "text") == [(1, 1, 62_003, 3_600_000, "Ann B", "Hi you &lt;\nthere"), (1, 2, 0, 1, None, "<x>")]


def test_new_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "track string, id long, start long, stop long, source_in long, gain_milli long, k long, v long, p double")
    for df in (
        clocks.windows_of(none, ["track"], 1, 1), clocks.conformed(none, ["track"], "k", 25, 1, 25), sound.mixed(none.withColumnRenamed("v", "value"), ["track"], "k"), sound.ducked(none, none, ["track"], 1, 1, 5, 9),
        sound.limited(none, ["track"], "k", "v", 1, 1, 1), sound.resampled(none, ["track"], "k", "v", 2, 3), sound.beats(none, ["track"], "k", "v", "p", 1.0), sound.filtered(none, ["track"], "k", "v", (1.0, 0.0, 0.0), (0.0, 0.0)),
        checks.transcript(none.withColumns({"pos": F.col("k"), "word": F.lit("x")}), ["track"]), otio.exported(none.withColumns({"kind": F.lit("Video"), "name": F.lit("x"), "url": F.lit("y")}), ["track"], "k", 25),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("rgb, want", [
    ((255, 0, 0), (0, 1000, 500)), ((255, 255, 0), (60_000, 1000, 500)), ((0, 255, 0), (120_000, 1000, 500)), ((0, 255, 255), (180_000, 1000, 500)), ((0, 0, 255), (240_000, 1000, 500)),
    ((255, 0, 255), (300_000, 1000, 500)), ((7, 7, 7), (None, 0, 27)), ((0, 0, 0), (None, 0, 0)), ((255, 255, 255), (None, 0, 1000)), ((255, 0, 1), (359_765, 1000, 500)),
])
def test_colours(spark, rgb, want):
    own = spark.range(1).select(pixels.hsl(*(F.lit(c).cast("long") for c in rgb)).alias("c"))
    assert tuple(own.first()["c"]) == want
    near = want[0] is not None and min(want[0], 360_000 - want[0]) <= 1000
    assert own.select(pixels.qualified(F.col("c"), (0, 1000, 1000), None, None), pixels.qualified(F.col("c"), (0, 1000, 1000), None, None, True)).first() == (float(near), float(not near))


def test_windows_are_stitched_at_their_seams(spark):
    windows = spark.createDataFrame([("t", 1, 0, 100), ("t", 2, 60, 160), ("t", 3, 200, 300), ("u", 1, 0, 9)], "track string, window long, start long, stop long")
    rows = [(1, 0, 10, 20), (1, 1, 70, 85), (1, 2, 78, 90), (2, 0, 61, 70), (2, 1, 80, 84), (2, 2, 85, 95), (2, 3, 150, 160), (3, 0, 200, 210)]
    words = spark.createDataFrame([("t", *r) for r in rows] + [("v", 1, 0, 1, 2)], "track string, window long, pos long, start long, stop long")
    # the first window keeps what has its middle before 80; its last word ends at 85, where the second begins
    assert found(transcripts.stitched(windows, words, ["track"]), "track", "window", "pos") == [("t", 1, 0), ("t", 1, 1), ("t", 2, 2), ("t", 2, 3), ("t", 3, 0)]


def test_steady_line_drops_outliers(spark):
    rng = random.Random(6)
    good = [(r, float(x), 7.5 * x + 100 * r + rng.uniform(-0.2, 0.2), 1.0 + (r == 1)) for r in range(3) for x in range(r * 10, r * 10 + 8)]
    bad = [(0, 3.0, 60.0, 0.3), (2, 25.0, 500.0, 0.3)]
    df = spark.createDataFrame([("t", *p) for p in good + bad] + [("one", 0, 1.0, 2.0, 1.0)], "track string, run long, x double, y double, w double")
    ((key, slope, intercept),) = found(signals.steady_line(df, ["track"], "run"), "track", "slope", "intercept")
    assert key == "t" and slope == pytest.approx(7.5, abs=0.05) and intercept == pytest.approx(100, abs=1)


def test_cubes_and_sounds_that_are_none(spark):
    rows = "\n".join(f"{r} {g} .5" for b in range(2) for g in range(2) for r in range(2))
    texts = [(1, f"# x\r\nLUT_3D_SIZE 2\r\nDOMAIN_MIN 0 0 0\r\n\n{rows}\n"), (2, f"LUT_3D_SIZE 3\n{rows}"), (3, rows), (4, None), (5, "")]
    got = media.parse_cube(spark.createDataFrame(texts, "id long, t string"), "id", "t")
    assert found(got.where("index = 1"), "id", "size", "r", "g", "b") == [(1, 2, 1.0, 0.0, 0.5)] and got.count() == 8
    samples = spark.createDataFrame([("a", 0, 0, 5), ("a", 1, 0, -7), ("a", 0, 2, 99_999), ("b", 0, 0, 1)], "f string, channel int, frame long, value long")
    files = media.encode_wav(samples, ["f"], 8_000)
    odd = spark.createDataFrame([("c", bytearray(b"RIFF")), ("d", None), ("e", bytearray(b"RIFF\0\0\0\0WAVEdata\4\0\0\0abcd"))], "f string, content binary")
    back = media.sound_samples(media.sound_blocks(files.unionByName(odd), "f", "content"), "f")
    assert found(back.where("value <> 0"), "f", "rate", "channel", "frame", "value") == [("a", 8000, 0, 0, 5), ("a", 8000, 0, 2, 32_767), ("a", 8000, 1, 0, -7), ("b", 8000, 0, 0, 1)]
    assert back.count() == 7
