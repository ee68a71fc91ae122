"""Steps that must grow no faster than their input: their results, and what their plans may not hold."""

import math
import random
import time

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

import __spark_entry__
from splicework.functions import expressions, scalars
from splicework.operators import checks, edits, language, reading, transcripts
from splicework.sources import otio

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lowest_terms_take_few_steps(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(-(10**k), 10**k), rng.randrange(1, 10 ** rng.randrange(1, 16))) for k in range(1, 16) for _ in range(6)]
    pairs += [(0, 7), (5, 0), (-3, 0), (6, -2), (2**53 - 1, 1), (2**53, 1), (2**53, 2), (2**62, 2**62 - 1), (832040, 1346269)]
    big = spark.createDataFrame([(str(a * k), str(b * k)) for a, b in pairs for k in (1, 10**9, 3**20)] + [(None, "1"), ("1", None)], "a string, b string")
    own = big.select("a", "b", scalars.reduced(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")).alias("t"))
    for a, b, t in own.collect():
        g = math.gcd(int(a or 0), int(b or 0)) or 1
        fits = a is not None and b is not None and int(b) > 0 and max(abs(int(a)), int(b)) // g <= scalars.MOST
        assert t == ((int(a) // g, int(b) // g) if fits else None), (a, b)
    assert plan(own).count("aggregate(") <= 2
    t = F.struct(F.col("id").alias("num"), F.lit(12).cast("long").alias("den"))
    graph = expressions.evaluated(spark.range(20).select(t.alias("t")), {"t": ("column", "t"), "twice": ("add", "t", "t")}, ["twice"])
    assert "sequence(1, 120" not in plan(graph)
    assert [r["twice"] for r in graph.collect()] == [(i // math.gcd(i, 6), 6 // math.gcd(i, 6)) for i in range(20)]


def test_undo_pointers_fold_many_projects_in_one_pass(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for project in range(40):
        back: list = []
        for i in range(rng.randrange(1, 12)):
            action = "create" if i == 0 else rng.choice(["apply", "undo", "restore"])
            own = rng.randrange(i) if action == "restore" else None
            rows.append((project, i, action, own))
            to = back[i - 1] if action == "undo" else None
            back.append((None if to is None else back[to]) if action == "undo" else i - 1 if i else None)
            want[project, i] = to if action == "undo" else own, back[i]
    rng.shuffle(rows)
    own = checks.undo_pointers(spark.createDataFrame(rows, "project long, revision long, action string, restored_from long"), "project")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {(r["project"], r["revision"]): (r["restored_from"], r["undo_target"]) for r in own.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "InPandas" not in plan(own)


def test_transcript_deals_out_no_words_that_have_the_stop_before(spark):
    own = __spark_entry__.queries()["flt9_transcript"](spark, SF)
    assert "Window" not in plan(own)
    words = spark.createDataFrame([(1, 0, "a", 0, 10, None), (1, 1, "b", 5, 20, 10), (1, 2, "c d", 20, 20, 20)], "asset long, pos long, word string, start long, stop long, before long")
    found = [sorted(map(tuple, checks.transcript(words, ["asset"], *b).collect())) for b in ([], ["before"])]
    assert found[0] == found[1] == [(1, 1, "overlap"), (1, 2, "length"), (1, 2, "token")]


def test_removals_deal_out_chosen_words_alone(spark):
    assert "lag(" not in plan(__spark_entry__.queries()["int29_removals"](spark, SF))
    rng, rows = random.Random(2), []
    for asset in range(5):
        at = 0
        for pos in range(30):
            stop = at + rng.randrange(1, 9)
            rows.append((asset, pos, at, stop, rng.random() < 0.4))
            at = stop + rng.randrange(0, 9)
    beside = [(*r, rows[i - 1][3] if r[1] else None, rows[i + 1][2] if r[1] < 29 else None) for i, r in enumerate(rows)]
    words = spark.createDataFrame(beside, "asset long, pos long, start long, stop long, hit boolean, b long, a long")
    found = [sorted(map(tuple, language.removals(words, F.col("hit"), ["asset"], "pos", 6, x).collect())) for x in (None, ("b", "a"))]
    assert found[0] == found[1] and len(found[0]) > 20


def test_two_lines_are_balanced_without_a_table():
    rng = random.Random(4)
    for _ in range(300):
        words = ["x" * rng.choice([1, 2, 3, 5, 9, 14]) for _ in range(rng.randrange(1, 9))]
        size = lambda part: len(" ".join(part))
        fits = lambda part: len(part) == 1 or size(part) <= 12
        if fits(words):
            assert reading.balanced(words, 12) == " ".join(words)
        elif halves := [(max(size(words[:j]), size(words[j:])), size(words[:j]), j) for j in range(1, len(words)) if fits(words[:j]) and fits(words[j:])]:
            j = min(halves)[2]
            assert reading.balanced(words, 12) == " ".join(words[:j]) + "\n" + " ".join(words[j:])
    began = time.process_time()
    for _ in range(1000):
        reading.balanced(["word"] * 79, 200)
    assert time.process_time() - began < 2


def test_findings_split_only_documents_that_clips_use(spark):
    assert "LeftSemi" in plan(__spark_entry__.queries()["int39_findings"](spark, SF))


def test_continuous_runs_without_a_table_of_runs(spark):
    rng, rows = random.Random(6), []
    for track in range(6):
        at, source_in, source = 0, 0, 0
        for _ in range(40):
            n = rng.randrange(0, 5)
            rows.append((track, at, at + n, source, source_in))
            at, source_in = at + n + rng.choice([0, 0, 0, 2]), source_in + n
            source += rng.random() < 0.2
    clips = spark.createDataFrame(rows, "track long, start long, stop long, id long, source_in long")
    own, want, last = edits.continuous(clips, ["track"], "id"), [], None
    for r in sorted(rows, key=lambda r: r[:3]):
        if last and last[0] == r[0] and last[2] == r[1] and last[3] == r[3] and last[4] - last[1] == r[4] - r[1]:
            want[-1] = (r[0], want[-1][1], r[2], want[-1][3] + 1)
        else:
            want.append(r[:3] + (1,))
        last = r
    assert sorted(map(tuple, own.collect())) == sorted(want)
    assert "Aggregate" not in plan(own)


def test_documents_gather_narrow_rows(spark):
    clips = spark.createDataFrame([(1, 0, 3, "a", 5), (1, 4, 6, "b", 0), (2, 2, 3, "c", 1)], "track long, start long, stop long, name string, source_in long")
    own = otio.exported(clips.withColumns({"lane": F.lit(0), "kind": F.lit("Video"), "url": F.col("name")}), ["track"], "lane", 25)
    lines = plan(own).split("\n")
    at = max(i for i, line in enumerate(lines) if "collect_list" in line)
    assert not any("Clip.1" in line for line in lines[at + 1 :])
    back = otio.imported(own.withColumnRenamed("track", "document"), "document", "otio", 25)
    assert sorted((r["document"], r["start"], r["stop"], r["name"], r["source_in"]) for r in back.collect()) == sorted(map(tuple, clips.collect()))


def test_words_of_even_windows_are_placed_without_a_join(spark):
    own = plan(__spark_entry__.queries()["int36_heard_once"](spark, SF))
    assert not any(x in own for x in ("Join", "Aggregate", "Generate", "Window")) and own.count("MapInArrow") == 1
    rng, rows = random.Random(9), []
    for asset in range(80):
        at, said = rng.choice([-50, 0, 0, 0, 90]), []
        for pos in range(rng.randrange(1, 40)):  # words longer than windows too, of no length, and gaps without words
            stop = at + rng.choice([0, 1, 2, 5, 9, 14, 30, 75])
            said.append((asset, pos, at, stop))
            at = stop + rng.choice([0, 0, 1, 3, 40])
        rows += [(*r, said[i + 1][2] if i + 1 < len(said) else None) for i, r in enumerate(said)]
    words = spark.createDataFrame(rows, "asset long, pos long, start long, stop long, after long").localCheckpoint()
    for step, length in ((30, 40), (10, 15), (7, 14), (20, 21), (12, 12)):
        held = words.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("start") / step))))
        held = held.where((F.col("part") >= 0) & (F.col("start") >= F.col("part") * step) & (F.col("start") < F.col("part") * step + length))
        windows = held.select("asset", "part", (F.col("part") * step).alias("start"), (F.col("part") * step + length).alias("stop")).distinct()
        want = sorted(tuple(r) for r in transcripts.heard_once(held, windows, ["asset"], "part").select("asset", "part", "pos").collect())
        found = transcripts.heard_once_evenly(words, step, length, "part").select("asset", "part", "pos")
        assert sorted(map(tuple, found.collect())) == want and 400 < len(want) < len(rows)


def test_alignment_deals_out_no_words(spark):
    for name in ("win19_differences", "agg15_match_summary", "jn20_alignment"):
        own = plan(__spark_entry__.queries()[name](spark, SF))
        assert not any(x in own for x in ("Join", "CoGroup", "Aggregate", "Window")) and own.count("MapInArrow") == 1


def _by_row(*names):
    """Rows of texts as their words and what goes with them, from arrays of structs beside a key."""

    def sides(batch):
        for name in names:
            own, row = pc.list_flatten(batch[name]), pc.list_parent_indices(batch[name])
            columns = dict(zip((f.name for f in own.type), own.flatten(), strict=True))
            yield pa.RecordBatch.from_pydict({"row": row.cast("int64"), "asset": batch["asset"].take(row), **columns})

    def read(batches):
        for batch in batches:
            yield (*sides(batch), batch["plan"].to_pylist()) if "plan" in batch.schema.names else tuple(sides(batch))

    return read


def test_corrections_deal_out_no_words(spark):
    own = plan(__spark_entry__.queries()["int37_corrected"](spark, SF))
    assert not any(x in own for x in ("Join", "Window", "Aggregate", "Union")) and own.count("MapInArrow") == 1
    rng, rows = random.Random(12), []
    for asset in range(50):
        n = rng.choice([0, 1, 9, 20])
        ids = rng.sample(range(40), n)
        said = [(ids[i], i, f"w{i}", 10 * i, 10 * i + 8) for i in range(n)]
        edits = []
        for i in rng.sample(range(40), rng.randrange(12)):
            op = rng.choice(["replace", "remove", "insert", "insert"])
            own = ("new", 10 * i + 1, 10 * i + 2) if op == "insert" or rng.random() < 0.6 else (None, None, None)
            edits.append((op, i, *own, rng.choice([None, *range(40)]) if op == "insert" else None))
        rows.append((asset, said, edits))
    shape = "array<struct<id long, pos long, text string, start long, stop long>>", "array<struct<op string, id long, text string, start long, stop long, before_id long>>"
    texts = spark.createDataFrame(rows, f"asset long, words {shape[0]}, edits {shape[1]}").coalesce(1)
    w, e = (texts.select("asset", F.explode(c).alias("x")).select("asset", "x.*") for c in ("words", "edits"))
    columns = ("asset", "pos", "id", "text", "start", "stop")
    want = sorted(map(tuple, language.corrected(w, e).select(*columns).collect()))

    found = language.corrected_texts(texts, _by_row("words", "edits")).select(*columns)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300


def test_cut_plans_deal_out_no_words(spark):
    own = plan(__spark_entry__.queries()["int30_cut_plan"](spark, SF))
    assert not any(x in own for x in ("Join", "Window", "Aggregate", "Union")) and own.count("MapInArrow") == 1
    for far in (10**9, 2**60 + 7):
        _cut_plans_agree(spark, far)


def _cut_plans_agree(spark, far):
    rng, rows = random.Random(13), []
    for asset in range(1, 60):
        at, said, cuts = rng.choice([0, -700, far]), [], []
        for pos in range(rng.choice([0, 1, 30])):
            stop = at + rng.choice([0, 1, 6, 12, 40])
            said.append((pos, f"é{pos}", at, stop))
            if rng.random() < 0.4:
                start = at + rng.randrange(-9, 30)
                cuts.append((start, start + rng.choice([0, 1, 4, 9, 50])))
            at = stop + rng.choice([0, 0, 5])
        rows.append((asset, said, cuts))
    shape = "array<struct<pos long, word string, start long, stop long>>", "array<struct<start long, stop long>>"
    texts = spark.createDataFrame(rows, f"asset long, words {shape[0]}, cuts {shape[1]}").coalesce(1)
    w, c = (texts.select("asset", F.explode(x).alias("x")).select("asset", "x.*") for x in ("words", "cuts"))
    made = language.fingerprints(w).where("asset % 5 <> 1").withColumn("fingerprint", F.when(F.col("asset") % 4 != 0, F.col("fingerprint")).otherwise("stale"))
    columns = ("asset", "pos", "start", "stop")
    want = sorted(map(tuple, language.cut_plan(w, c, made, "asset", 10).select(*columns).collect()))
    texts = texts.join(made, "asset", "left").withColumnRenamed("fingerprint", "plan").coalesce(1)
    read = _by_row("words", "cuts")

    def words(batches):
        for said, cuts, plan_ in read(batches):
            yield said.append_column("digest", language.digests(said)), cuts, plan_

    found = language.cut_plan_texts(texts, words, "asset").select(*columns)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 150
