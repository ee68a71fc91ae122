"""Alignment, layout and edits' helpers against brute force and fixed cases."""

import random
import time
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from splicework.operators import edits, reading, snapshots, transcripts
from splicework.plans import adapters


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


SHAPE = "asset string, pos long, word string, letters string, start long, stop long"


def side(spark, rows):
    return spark.createDataFrame([("a", i, t.upper(), t, s, e) for i, (t, s, e) in enumerate(rows)], SHAPE)


def brute(want, got, tolerance):
    """Every heard word and shape in turn."""
    rows, i, behind = [], 0, 0
    while i < len(want):
        hit = None
        for k in range(behind, len(got)):
            for n, m in [(1, 1), *((1, x) for x in range(2, 9)), *((x, 1) for x in range(2, 9))]:
                a, b = want[i : i + n], got[k : k + m]
                if len(a) == n and len(b) == m and "".join(x[0] for x in a) == "".join(x[0] for x in b) != "" and abs(a[0][1] + a[-1][2] - b[0][1] - b[-1][2]) <= 2 * tolerance:
                    hit = n, k, m
                    break
            if hit:
                break
        if hit:
            rows.append((i, hit[0], hit[1], hit[2]))
            i, behind = i + hit[0], hit[1] + hit[2]
        else:
            i += 1
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_alignment_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def text(n):
        at, out = 0, []
        for _ in range(n):
            t = rng.choice(["a", "b", "ab", "aab", "", "ba"])
            at += rng.randint(0, 3)
            out.append((t, at, at + len(t) + 1))
            at += len(t) + 1
        return out

    want, got = text(40), text(40)
    assert found(reading.aligned(side(spark, want), side(spark, got), ["asset"], 6), "expected", "n_expected", "heard", "n_heard") == brute(want, got, 6)


def test_joined_words_and_differences(spark):
    want = side(spark, [("every", 0, 5), ("one", 5, 8), ("sees", 9, 12), ("it", 13, 15), ("now", 16, 19)])
    got = side(spark, [("everyone", 0, 8), ("so", 8, 9), ("it", 13, 15), ("no", 16, 17), ("w", 17, 19), ("end", 20, 25)])
    matches = reading.aligned(want, got, ["asset"], 3)
    assert found(matches, "expected", "n_expected", "heard", "n_heard") == [(0, 2, 0, 1), (3, 1, 2, 1), (4, 1, 3, 2)]
    assert found(reading.differences(want, got, matches, ["asset"]), "after", "start", "stop", "expected", "heard") == [(2, 8, 12, "SEES", "SO"), (4, 20, 25, "", "END")]
    assert found(reading.match_summary(want, matches, ["asset"]), "words", "matched", "joined", "ratio") == [(5, 4, 2, 0.8)]
    none = want.where("false")
    assert reading.aligned(none, got, ["asset"], 3).count() == reading.aligned(want, none, ["asset"], 3).count() == 0


def test_lines_are_balanced():
    rng = random.Random(8)
    for _ in range(300):
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(1, 8))]
        width = rng.randint(4, 14)
        lines, row = 1, len(words[0])
        for w in words[1:]:
            lines, row = (lines, row + 1 + len(w)) if row + 1 + len(w) <= width else (lines + 1, len(w))
        options = []
        for cut in combinations(range(1, len(words)), lines - 1):
            parts = [words[a:b] for a, b in zip((0, *cut), (*cut, len(words)), strict=True)]
            sizes = [len(" ".join(p)) for p in parts]
            if all(s <= width or len(p) == 1 for s, p in zip(sizes, parts, strict=True)):
                options.append((max(sizes), sizes, "\n".join(map(" ".join, parts))))
        assert reading.balanced(words, width) == min(options)[2]
    assert reading.balanced([], 5) == ""


def test_snippets_show_both_ends(spark):
    rows = spark.createDataFrame([("a", i, f"w{i}", i == 0) for i in range(7)] + [("b", 0, "x", True)], "clip string, pos int, word string, partial boolean")
    assert found(reading.snippets(rows, ["clip"], 3), "clip", "count", "text") == [("a", 7, "w0* w1 ... w6"), ("b", 1, "x*")]
    assert found(reading.snippets(rows, ["clip"], 1), "text") == [("w0* ...",), ("x*",)]


@pytest.mark.parametrize("num, den, text", [(0, 1, "0"), (5, 2, "2.5"), (1, 3, "0.333~"), (2, 3, "0.667~"), (1999999, 1_000_000, "2~"), (61, 1, "61"), (1, 2000, "0.001~")])
def test_clock(spark, num, den, text):
    assert spark.range(1).select(reading.clock(F.struct(F.lit(num).alias("num"), F.lit(den).alias("den")))).first()[0] == text


def test_batches_are_all_or_nothing(spark):
    clips = spark.createDataFrame([("t", 1, 0, 10, 5)], "track string, id long, start long, stop long, source_in long")
    short = lambda c: c.where("stop <= start")
    assert edits.applied(clips, [lambda c: c.withColumn("stop", F.col("stop") - 3)], short).first()["stop"] == 7
    with pytest.raises(ValueError, match="the edits leave"):
        edits.applied(clips, [lambda c: c.withColumn("stop", F.lit(0).cast("long"))], short)
    with pytest.raises(ValueError):
        edits.applied(clips, [], short)


def test_levels_take_the_longest_way(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "parent string, child string")
    assert found(snapshots.levels(edges, 8), "node", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_documents_without_assets_stay(spark):
    d = spark.createDataFrame([(1, "a\\b", "s1"), (2, "c", "s2"), (3, None, None)], "id long, path string, sha256 string")
    a = spark.createDataFrame([(10, "a/b", None), (11, "z", "s2"), (12, "y", "s2")], "id long, path string, sha256 string")
    assert sorted(map(tuple, reading.bound(d, a).collect()), key=str) == [(1, 10), (2, 11), (2, 12), (3, None)]


def test_links_are_followed_by_rounds(spark):
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("c", 3), ("d", 3), ("e", None), ("a", None)], "track string, link long")
    start = members.where("track = 'a'")
    assert found(snapshots.reached(members, start, "track", "link"), "track", "round") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_edits_that_do_not_fit_change_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, text string")
    fits = spark.createDataFrame([(1, "remove", None), (2, "replace", "c"), (4, "add", "d")], "id long, op string, text string")
    assert found(snapshots.edited(rows, fits, ["id"], ["text"]), "id", "text") == [(2, "c"), (3, None), (4, "d")]
    bad = spark.createDataFrame([(1, "add", "x"), (5, "remove", None), (6, "replace", "y"), (2, "remove", None), (2, "remove", None)], "id long, op string, text string")
    assert found(snapshots.edited(rows, bad.where("id <> 2"), ["id"], ["text"]), "id", "text") == [(1, "a"), (2, "b"), (3, None)]
    assert found(snapshots.misfits(rows, bad, ["id"]), "id", "issue") == [(1, "exists"), (2, "repeated"), (2, "repeated"), (5, "missing"), (6, "missing")]


def test_words_of_a_long_text_take_no_longer_a_word(spark, tmp_path):
    texts = ["", " a  b ", "é𝄞 x", None, "one two " * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got: dict = {}
    for r in sorted(adapters.words(spark, str(tmp_path)).collect(), key=lambda r: (r["asset"], r["pos"])):
        got.setdefault(r["asset"], []).append((r["pos"], r["word"], r["start"], r["stop"]))
    assert time.monotonic() - began < 30  # 200,001 words; a scan of the text for each 256 of them takes minutes
    for i, text in enumerate(texts):
        want, at = [], 0
        for n, w in enumerate(text.split(" ") if text is not None else []):
            want.append((n, w, at, at + len(w) * 10))
            at += (len(w) + 1) * 10
        assert got.get(i, []) == want


def test_many_windows_of_a_key_are_stitched_in_one_pass(spark):
    n = 4_000
    windows = spark.range(n).selectExpr("1L k", "id window", "id * 600 start", "id * 600 + 900 stop")
    words = windows.selectExpr("k", "window", "explode(sequence(0L, 29L)) i", "start").selectExpr("k", "window", "window * 20 + i pos", "start + i * 30 start", "start + i * 30 + 30 stop")
    began = time.monotonic()
    got = transcripts.stitched(windows, words, ["k"])
    assert got.count() == got.select("pos").distinct().count() == 20 * n + 10
    assert time.monotonic() - began < 25  # a scan of the key's words for each window: 480 million of them


def test_a_word_heard_often_is_looked_for_within_tolerance_alone(spark):
    n = 30_000  # one word, said again and again, never within tolerance: no look at each place for each word
    said = spark.createDataFrame([(1, i, "a", i * 20, i * 20 + 10) for i in range(n)], "k long, pos long, letters string, start long, stop long")
    heard = said.withColumns({"start": F.col("start") + 10, "stop": F.col("stop") + 10})
    began = time.monotonic()
    assert reading.aligned(said, heard, ["k"], 9).count() == 0
    assert time.monotonic() - began < 25
    assert reading.aligned(said, heard, ["k"], 10).count() == n


def test_keys_without_words_or_windows_are_stitched_to_nothing(spark):
    windows = spark.createDataFrame([("a", 1, 0, 9), ("b", 1, 0, 9)], "k string, window long, start long, stop long")
    words = spark.createDataFrame([("b", 1, 0, 1, 2), ("c", 1, 0, 1, 2)], "k string, window long, pos long, start long, stop long")
    assert found(transcripts.stitched(windows, words, ["k"]), "k", "window", "pos") == [("b", 1, 0)]


def test_words_of_used_documents_alone(spark, tmp_path):
    spark.createDataFrame([(i, f"a b{i}") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    used = spark.createDataFrame([(1,), (1,), (3,), (9,)], "asset long")
    assert found(adapters.words(spark, str(tmp_path), used), "asset", "pos", "word") == [(1, 0, "a"), (1, 1, "b1"), (3, 0, "a"), (3, 1, "b3")]


def test_texts_are_matched_in_place_as_their_words_are(spark):
    rng, shape = random.Random(3), "array<struct<pos long, letters string, word string, start long, stop long>>"

    def text(n, at):
        out = []
        for _ in range(n):
            t = rng.choice(["a", "b", "ab", "aab", "", "ba", "bab"])
            at += rng.randint(0, 3)
            out.append((t, at, at + len(t) + 1))
            at += len(t) + rng.randint(0, 1)
        return out

    def words(batches):
        for batch in batches:
            sides = []
            for name in ("want", "got"):
                own = pc.list_flatten(batch[name])
                row = pc.list_parent_indices(batch[name])
                columns = dict(zip((f.name for f in own.type), own.flatten(), strict=True))
                sides.append(pa.RecordBatch.from_pydict({"k": batch["k"].take(row), "text": row.cast("int64"), **columns}))
            yield tuple(sides)

    told = [(None if k == 7 else k, text(rng.choice([0, 1, 25, 40]), at := rng.choice([0, -900, 10**9])), text(rng.choice([0, 1, 25, 40]), at)) for k in range(1, 61)]
    far = [(100, text(20, 2**60 + 5), text(20, 2**60 + 5)), (101, text(20, 0), text(20, 0))]
    for rows, tolerance in ((told, 0), (told, 4), (told, 500), (far, 4)):
        full = [(k, *([(i, t, t.upper(), a, b) for i, (t, a, b) in enumerate(side)] for side in sides)) for k, *sides in rows]
        own = spark.createDataFrame(full, f"k long, want {shape}, got {shape}").coalesce(1)
        want = sorted((k or 7, *m) for k, a, b in rows for m in brute(a, b, tolerance))
        assert len(want) > (100 if tolerance == 500 else 10)
        assert sorted((r[0] or 7, *r[1:]) for r in reading.aligned_texts(own, words, ["k"], tolerance).collect()) == want
        named = own.withColumn("k", F.coalesce("k", F.lit(7)))
        a, b = (named.select("k", F.explode(c).alias("w")).select("k", "w.*") for c in ("want", "got"))
        matches = spark.createDataFrame(want, "k long, expected long, n_expected long, heard long, n_heard long")
        columns = ("k", "after", "start", "stop", "expected", "heard")
        assert found(reading.differences_texts(named, words, ["k"], tolerance), *columns) == found(reading.differences(a, b, matches, ["k"]), *columns)
        columns = ("k", "words", "matched", "joined", "ratio")
        assert found(reading.match_summary_texts(named, words, ["k"], tolerance), *columns) == found(reading.match_summary(a, matches, ["k"]), *columns)
