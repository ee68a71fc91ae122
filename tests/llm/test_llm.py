"""The ten operators and the pipeline against brute force, and on awkward tables."""

import base64
import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from splicework.llm import decontaminate, interpolated_lm, line_rules, mixing, near_copies, pii, quality, simhash, textarrays, token_counts, url_filter, warc
from splicework.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "rho"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in all columns, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(1)
    base = sentence(rng, 60) + "."
    texts = [None, "", " \n\t", base, base, base + " more", "a", sentence(rng, 40_000), "x" * 300_000, "mail a.b@c.example.org or +1 (234) 567-8901 now", "ü€😀 " * 50]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), rows[3], rows[3], (99, None, None, None, None)]
    names = ["label", "x", "key", "block", "size", "fp", "row", "_id", "_row", "quality", "component_id"]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


def test_word_hashes_do_not_depend_on_pieces():
    rng = random.Random(2)
    text = sentence(rng, 60_000).encode() + b"\n" + b"Z" * 10 + b" " + "é".encode() * 5
    h, at = textarrays.word_hashes(text)
    words = text.lower().split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert [text[a : a + len(w)].lower() for a, w in zip(at, words, strict=True)] == words
    assert (textarrays._slow(text, textarrays.PLAIN)[0] == h).all()


def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fingerprint); the least id reachable of each."""
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                parent[find(p)] = find(q)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, p, least.get(find(p))) for i, p in rows]


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    of = [collections.defaultdict(set), collections.defaultdict(set)]
    for side, prints in zip(of, (a, b), strict=True):
        rows, keys = simhash.keys(prints)
        for r, k in zip(rows, keys, strict=True):
            side[r].add(int(k))
    assert all(of[0][i] & of[1][i] for i in range(len(a)))
    assert max(map(len, of[0].values())) <= 33


def test_links_of_large_groups_connect_them():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base]))
    a, b = simhash.links(np.zeros(len(fp), np.int64), fp)
    want = brute_components([(i, int(p)) for i, p in enumerate(fp)])
    assert len(a) == len(fp) - len({c for _, _, c in want}) and (np.bitwise_count(a ^ b) <= 4).all()


def test_simhash_against_brute_force(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([(r["doc_id"], brute_print(r["text"] or "")) for r in docs.collect()])
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def brute_near(texts):
    """Component (its least place) of each text, by five-word shingles of which 0.8 or more are common."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    return comp


def near_texts():
    """Copies with some words changed, around a similarity of 0.8, and a chain whose ends are unlike."""
    rng = random.Random(21)
    texts = [None, "", "a b", "a b", "a b c", *(" ".join(sentence(rng, 60).split()) for _ in range(5))]
    for base in texts[5:]:
        for k in (0, 1, 1, 2, 2, 3, 3, 4):
            words = base.split()
            for _ in range(k):
                words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    words = sentence(rng, 100).split()
    for i in range(20):
        words[5 * i] = f"step{i}"
        texts.append(" ".join(words))
    return texts


def test_near_copies_against_brute_force(spark):
    texts = near_texts()
    comp = brute_near(texts)
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = corpus_pipeline.deduplicate(spark, rows.repartition(5), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(comp)) and got.columns == rows.columns


def test_filters_judge_rows_and_not_ids(spark):
    """Null and repeated ids: one row of each group stays, and a row with an item takes no other with it."""
    rng = random.Random(23)
    a, b, c, item = (sentence(rng, 60) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " more"), (7, b), (7, b), (7, c), (1, c), (None, "x " + item), (5, item + " y"), (5, sentence(rng, 50)), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()]
    assert len(left) == 6 and {t for _, t in left if t.startswith(a)} < {a, a + " more"}
    assert [i for i, t in left if t == b] == [7] and [i for i, t in left if t == c] == [1] and (None, "") in left
    tests = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = decontaminate.without_items(docs, tests)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted((i or 0, t) for i, t in rows if item not in t) and left.columns == docs.columns


def test_candidates_skip_what_is_connected():
    """No pair within a root; a run of two roots that are near has one pair, one of far roots none; without roots a forest spans the run."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 2, dtype=np.uint64)
    fp = np.array([base ^ (np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64)) for _ in range(60)])
    far = fp.copy()
    far[30:] = ~far[30:]
    key, halves = np.zeros(60, np.int64), np.repeat([5, 9], 30)
    pairs = lambda *args: list(zip(*(side.tolist() for side in near_copies.candidates(*args)), strict=True))
    assert len(pairs(key, fp)) == 59 and len(pairs(key, far)) == 58
    assert pairs(key, fp, np.full(60, 7)) == [] and pairs(key, far, halves) == []
    [(a, b)] = pairs(key, fp, halves)
    assert (a < 30) != (b < 30)
    small = np.repeat(np.arange(6), 10)  # runs of ten: all pairs between roots
    assert len(pairs(small, fp, np.tile([5, 9], 30))) == 6 * 25


def test_contracted_edges(spark):
    rng = random.Random(41)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000, 1000 + i) for i in range(50)]
    pairs = [(a, b) for a, b in pairs if a != b]
    least = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["root"] for r in near_copies.contracted(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: m for n, m in least.items() if n != m}
    assert near_copies.contracted(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def brute_contained(docs, items):
    out = []
    for d, text in docs:
        own = set(decontaminate.shingles((text or "").encode()))
        for i, t in items:
            s = set(decontaminate.shingles((t or "").encode()))
            if s and len(s & own) >= 0.8 * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=str)


def test_decontamination_finds_short_items_in_long_documents(spark, awkward, empty):
    rng = random.Random(5)
    items = [(i, sentence(rng, n)) for i, n in enumerate([12, 25, 40, 60, 3, 0])] + [(None, None), (1, "repeated id " + sentence(rng, 20))]
    longs = []
    for k, (i, t) in enumerate(items[:4]):
        words = t.upper().split() if k % 2 else t.split()
        words[len(words) // 2] = "changed" if k == 3 else words[len(words) // 2]
        longs.append((1000 + i, sentence(rng, 5000 * k) + ", " + " ".join(words) + "! " + sentence(rng, 3000), None, None, None))
    docs = spark.createDataFrame(longs, DOCS).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars")).withColumns({n: F.lit(n) for n in ("item_id", "n_shared", "containment", "_splicework_x")})
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    found = decontaminate.search(docs, tests)
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()), key=str)
    assert got == brute_contained([(r["doc_id"], r["text"]) for r in docs.collect()], items) and {1000, 1001, 1002, 1003} <= {r[0] for r in got}
    left = decontaminate.without_items(docs, tests)
    assert left.where("doc_id >= 1000").count() == 0 and left.columns == docs.columns
    assert decontaminate.search(empty, tests).count() == 0 and decontaminate.search(docs, tests.limit(0)).count() == 0
    assert decontaminate.without_items(docs, tests.limit(0)).count() == docs.count()


def test_containment_search_by_size():
    """Items of 1 to 300 shingles at a containment of 0.8 or a little more, in documents of 2,000 words; and ones below it."""
    rng = random.Random(6)
    items, docs, inside = [], [], []
    for q in [*range(1, 61), 80, 100, 150, 200, 300] * 3:
        words = sentence(rng, q + 4).split()
        items.append((len(items), " ".join(words).encode()))
        last = min(range(len(words) + 1), key=lambda k: (k - 4 < 0.8 * q, k))
        text = f"{sentence(rng, 1000)} {' '.join(words[:last])} {sentence(rng, 1000)}".encode()
        docs.append(text)
        inside.append(last - 4 >= 0.8 * q)
    block = decontaminate.Items(items)
    met = lambda text, i: i in block.candidates(np.unique(decontaminate.hashes(text)[0]))
    recall = sum(met(t, i) for i, t in enumerate(docs)) / sum(inside)
    assert all(inside) and recall >= 0.99
    assert all(sum(met(sentence(rng, 2000).encode(), i) for i in range(3)) == 0 for _ in range(20))
    for i, text in enumerate(docs):
        assert {r[0] for r in block.contained(text, np.unique(decontaminate.hashes(text)[0]))} == ({i} if met(text, i) else set())
    assert decontaminate.threshold(300) > 1 and len(decontaminate.minima(np.sort(np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2)), 9)) < 20_000


def test_containment_in_a_text_of_millions_of_words():
    rng = np.random.default_rng(7)
    item = b"one two three four five six seven eight nine ten eleven twelve"
    text = b" ".join(b"w%d" % x for x in rng.integers(0, 10**6, 2_000_000)) + b" " + item
    block = decontaminate.Items([(i, b"x%d " % i + item) for i in range(500)])
    assert len(list(block.contained(text, np.unique(decontaminate.hashes(text)[0])))) == 500


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 50)
    rng = random.Random(8)
    items = [(i, sentence(rng, 15)) for i in range(20)]
    docs = [(i, sentence(rng, 50) + " " + items[i][1]) for i in range(0, 20, 3)]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect()), key=str) == brute_contained(docs, items)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = f"{version} 0 maker\nfields\n".encode()
    data = b"filedesc://x 0.0.0.0 20010101000000 text/plain %d\n%s\n" % (len(block), block)
    more = b" 200 - - 0 x.arc" if version == 2 else b""
    for body in (b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\nWARC/1.1", b""):
        data += b"http://a.example/b c 1.2.3.4 199912312359 text/html" + more + b" %d\n%s\n" % (len(body), body)
    for raw in (data, zlib.compress(data, wbits=31), b"".join(zlib.compress(data[i : i + 40], wbits=31) for i in range(0, len(data), 40))):
        rows = list(warc.parse_arc("x.arc", raw))
        assert [(r["url"], r["date"], r["payload"]) for r in rows] == [("http://a.example/b c", "1999-12-31T23:59:00Z", b"body\nWARC/1.1"), ("http://a.example/b c", "1999-12-31T23:59:00Z", b"")]


def test_arc_faults(spark, tmp_path):
    """Bad records are reported and left out; the records around them are read."""
    good = lambda n, body: b"http://a.example/%d 1.2.3.4 20000101000000 text/plain %d\n%s\n" % (n, len(body), body)
    head = b"filedesc://x 0.0.0.0 20010101000000 text/plain 9\n1 0 maker\n"
    data = head + good(1, b"one") + b"http://b.example/ 1.2.3.4 20000101 text/html many\nrubbish\n" + good(2, b"two") + b"\x00\xff\n" + good(3, b"three") + b"http://c.example/ 1.2.3.4 20000101 text/html 999\nshort"
    rows = list(warc.parse_arc("x.arc", data))
    assert [(r["payload"], r["error"]) for r in rows] == [(b"one", None), (None, "header"), (b"two", None), (None, "header"), (b"three", None), (None, "length")]
    assert [r["error"] for r in warc.parse_arc("x.arc", b"filedesc://x 0.0.0.0 2001 text/plain 9\n3 0 maker\n" + good(1, b"one"))] == ["version", "header"]
    packed = zlib.compress(head + good(1, b"one"), wbits=31) + zlib.compress(good(2, b"two" * 1000), wbits=31)
    assert [r["error"] for r in warc.parse_arc("x.arc", packed)] == [None, None]
    assert [r["error"] for r in warc.parse_arc("x.arc", packed[:-20])][-1] == "gzip" and [r["error"] for r in warc.parse_arc("x.arc", packed + b"rubbish behind it")][:2] == [None, None]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/x.arc").write_bytes(data)
    (tmp_path / "arc/y.arc").write_bytes(head + good(4, b"two"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc"), ["url", "record_type", "payload_bytes", "payload_digest", "payload"]).collect()
    assert sorted((r["url"][-1], r["record_type"], r["payload_bytes"]) for r in got) == [("1", "resource", 3), ("2", "revisit", 3), ("3", "resource", 5), ("4", "resource", 3)]
    assert {r["error"] for r in warc.faults(spark, str(tmp_path / "arc")).collect()} == {"header", "length"}


def test_warc_round_trip(spark):
    html = ["a\r\n\r\nWARC/1.1\r\n", None, "", "é" * 100_000, "a\r\n\r\nWARC/1.1\r\n", "a\r\n\r\nWARC/1.1\r\n", "once"]
    rows = [(i, None if i == 2 else f"http://h.example/{i} {i}", h) for i, h in enumerate(html)] + [(None, "u", "once"), (None, None, "none")]
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        r = got[i, base64.b32encode(hashlib.sha1(data).digest()).decode()]
        first = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        assert r["payload_bytes"] == len(data)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))


def test_warc_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_held_out(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("quality", "quality_score").collect()
    assert len(rows) > 50 and sum((r["quality_score"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)
    scored = quality.scored(awkward, model)
    assert scored.count() == awkward.count() and all(0 <= r[0] <= 1 for r in scored.select("quality_score").collect())
    nothing = quality.fit(docs, labels.where("false"))
    assert {r[0] for r in quality.scored(awkward, nothing).select("quality_score").collect()} == {0.5}
    assert quality.scored(empty, model).count() == 0


def test_quality_fit_against_brute_force():
    """The weights are where the ridge and logistic loss of the preference pairs is least, by plain gradient descent; the threshold is the quantile."""
    rng = np.random.default_rng(11)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.standard_normal((400, quality.N_FEATURES)) + 0.5 * y[:, None] * rng.random(quality.N_FEATURES)
    model = quality.bradley_terry(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    pick = np.random.default_rng(5)
    good, bad = z[y == 1], z[y == 0]
    d = good[pick.integers(0, len(good), quality.PAIRS)] - bad[pick.integers(0, len(bad), quality.PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(400):
        w -= 1.0 * (quality.RIDGE * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d))
    assert np.abs(w - model.weights).max() < 1e-3
    strengths = np.sort(z @ model.weights)
    assert strengths[len(bad) - 1] <= model.threshold <= strengths[len(bad)]
    score = model.score(x)
    assert ((score >= quality.CUT) == (z @ model.weights >= model.threshold)).all() and (score >= quality.CUT).sum() == len(good)
    tied = quality.bradley_terry(np.repeat(x[:20], 2, axis=0), np.tile([0, 1], 20))
    assert len(set(tied.score(np.repeat(x[:1], 5, axis=0)).tolist())) == 1


def test_quality_fit_uses_all_labelled_rows(spark):
    """The weights are where the loss over all pairs is least, by plain gradient descent; a small bound of rows on the driver changes nothing."""
    rng = np.random.default_rng(12)
    y = (rng.random(600) < 0.6).astype(int)
    x = rng.standard_normal((600, quality.N_FEATURES)) + 0.5 * y[:, None] * rng.random(quality.N_FEATURES)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "label int, x array<double>").repartition(5)
    model = quality.fitted(rows, most=20)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(x.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp((good @ w)[:, None] - bad @ w)) / (len(good) * len(bad))
        w -= quality.RIDGE * w - (p.sum(1) @ good - p.sum(0) @ bad)
    assert np.abs(w - model.weights).max() < 1e-3
    s = np.sort(z @ model.weights)
    assert abs(model.threshold - (s[len(bad) - 1] + s[len(bad)]) / 2) < 1e-9
    assert (model.score(x) >= quality.CUT).sum() == len(good)
    assert np.abs(quality.bradley_terry(x, y).weights - model.weights).max() < 0.05
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 3 * (i % 2)) + "#" * (i % 5)) for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    few, many = quality.fit(docs, labels, most=50), quality.fit(docs, labels)
    assert np.abs(few.weights - many.weights).max() < 1e-6 and abs(few.threshold - many.threshold) < 1e-6


def test_quality_reads_a_bounded_number_of_rows(spark):
    docs = spark.createDataFrame([(1 + i % 2, f"text {i}") for i in range(500)], "doc_id long, text string").withColumns({n: F.lit(1) for n in ("label", "h", "t", "x")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, most=50)
    assert quality.scored(docs, model).count() == 500 and 0 < quality.scored(docs, model).first()["quality_score"] < 1


def test_simhash_of_empty_and_clashing_tables(spark, awkward, empty):
    assert simhash.near_duplicates(empty).count() == 0
    clash = awkward.withColumns({"root": F.lit(1), "node": F.lit(2), "least": F.lit(3)})
    assert simhash.near_duplicates(clash).count() == awkward.count()


def test_lm_against_brute_force(spark, awkward):
    """Counts, buckets, deletion, EM (on each token's own probabilities) and scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    pairs = lambda t: list(zip([None, *t[:-1]], t, strict=True))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learned = [tokens(r["text"]) for r in rows if not held(r["doc_id"])]
    c = collections.Counter(w for t in learned for w in t)
    c2 = collections.Counter(p for t in learned for p in pairs(t))
    n, v = sum(c.values()), len(c)
    events = []  # bucket, p2, p1 of each training token, its document's own counts deleted
    for t in learned:
        own, own2 = collections.Counter(t), collections.Counter(pairs(t))
        for k, (u, w) in enumerate(pairs(t)):
            before = c[u] - own[u] if k else len(learned) - 1
            events.append((before.bit_length(), (c2[u, w] - own2[u, w]) / before if before else 0.0, (c[w] - own[w]) / (n - len(t))))
    at, p = np.array([e[0] for e in events]), np.array([[e[1], e[2], 1 / (v + 1)] for e in events])
    weights = np.tile([0.4, 0.59, 0.01], (66, 1))
    weights[0] = [0, 0.99, 0.01]
    for _ in range(interpolated_lm.STEPS):
        share = weights[at] * p
        share /= share.sum(1, keepdims=True)
        weights = np.stack([np.bincount(at, share[:, i], 66) for i in range(3)], axis=1) + 0.5
        weights[0, 0] = 0
        weights /= weights.sum(1, keepdims=True)
    met = interpolated_lm.with_counts(docs)
    got_weights = interpolated_lm.learn_weights(interpolated_lm.held_out_counts(met, n, len(learned)), v)
    assert np.abs(got_weights - weights)[np.unique(at)].max() < 2e-3
    got = sorted(interpolated_lm.scores(docs.withColumns({x: F.lit(1) for x in ("block", "held_out", "shard", "score")})).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))
    want = []
    for r in rows:
        t = tokens(r["text"])
        s = 0
        for u, w in pairs(t):
            a, b, d = weights[c[u].bit_length()]
            s += math.log10(a * (c2[u, w] / c[u] if c[u] else 0) + b * c[w] / n + d / (v + 1))
        want.append((r["doc_id"], held(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), s))
    want.sort(key=lambda r: (str(r[0]), r[2], r[5]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and g["base_score"] == pytest.approx(w[5]) and g["score"] == pytest.approx(w[6], rel=1e-3)
    held_rows = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)


def test_lm_of_nothing(empty):
    assert interpolated_lm.scores(empty).count() == 0


def test_line_rules(spark, awkward, empty):
    clean = "This is a first plain line of words, with a stop.\nThen comes another one that ends well.\nEnd."
    menu = "Home | News | Sport | About | Contact | Login\nAccept all cookies to go on.\nFree!! Buy!! Now!! Great!! Deal!!\n" + "This is a first plain line of words, with a stop."
    repeat = "one two three four five six " * 4
    rows = spark.createDataFrame([(1, clean), (2, menu), (3, repeat)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_rules.verdicts(rows).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3)] == [True, False, False]
    assert got[3]["n_repeat_words"] == 24 and got[3]["base_failed"]
    mostly = spark.createDataFrame([(1, clean + "\nHome | News | Sport | About")], "doc_id long, text string")
    assert line_rules.clean(mostly).first()["text"] == clean
    rng = random.Random(9)
    others = [sentence(rng, 12) + "." for _ in range(4)]
    lines = [clean, "", "Une ligne qui se lit bien, avec un point.", "Cliquez ici pour lire.", "12 345 678 90 12 34.", "https://a.example www.b.example", "End.", "", *others]
    again = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").withColumns({"row": F.lit(1), "clean": F.lit(2), "_lr_lines": F.lit(3)})
    first = line_rules.clean(again).first()
    assert first["text"] == "\n".join([clean, "", lines[2], "", *others]) and first["_lr_lines"] == 3
    got = line_rules.verdicts(awkward).collect()
    assert len(got) == awkward.count() and all(not r["kept"] and r["n_words"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 99))
    assert line_rules.clean(awkward).columns == awkward.columns
    assert line_rules.verdicts(empty).count() == 0


def test_repeat_words_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(200)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in line_rules.verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(windows)
        assert got[i] == len({p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 5)})


def test_token_counts_against_brute_force(spark, awkward, empty):
    pieces = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁a": -3.5, "ba": -4.5, "▁ab": -7.0, "é": -5.0}

    def best(token):
        at = [(0.0, 0)]
        for e in range(1, len(token) + 1):
            options = [(at[e - 1][0] + token_counts.UNKNOWN, at[e - 1][1] + len(token[e - 1].encode()))]
            options += [(at[s][0] + pieces[token[s:e]], at[s][1] + 1) for s in range(e) if token[s:e] in pieces]
            at.append(max(options, key=lambda x: (x[0], -x[1])))
        return at[-1][1]

    rng = random.Random(8)
    tokens = ["▁" + "".join(rng.choice("abé😀") for _ in range(rng.randrange(9))) for _ in range(500)]
    tokens += ["▁" + "ab" * 100, "▁" + "é" * 200, "▁" + "ba" * 90 + "é", tokens[0]]
    trie = token_counts.Trie(pieces, 3)
    assert [trie.insert(t) for t in tokens] == [best(t) for t in tokens] and trie.terminals == {t: best(t) for t in tokens if len(t) <= token_counts.DEPTH}
    prefixes = {t[:k] for t in tokens for k in range(1, min(len(t), token_counts.DEPTH) + 1)}
    assert len(trie.children) == len(prefixes) + 1  # one node, and one computation, a shared prefix
    vocabulary = token_counts.zipf_pieces("/opt/tokenizers/piece_bpe_32k.model")
    assert math.fsum(math.exp(p) for p in vocabulary.values()) == pytest.approx(1) and sorted(vocabulary.values(), reverse=True) == list(vocabulary.values())
    rows = spark.createDataFrame([(i, " ".join(t[1:] for t in tokens[i : i + 9])) for i in range(100)], "doc_id long, text string")
    sums = {i: sum(best("▁" + w) for w in t.split()) for i, t in rows.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(rows, pieces).collect()} == sums
    got = token_counts.counted(awkward, pieces).collect()
    assert len(got) == awkward.count()
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 99))
    assert token_counts.counted(empty, pieces).count() == 0


def test_url_filter(spark):
    rows = [(1, "https://WWW.Example.com/en/1?x"), (2, "http://a.example.com/en/2"), (3, "http://x.com/"), (4, "http://x.com"), (5, None), (6, "no url"), (7, "http://b.net/es/x"), (8, "http://b.net/de/x#y"), (8, "http://b.net/de/x#y"), (None, "http://x.org/ü😀"), (9, "http://İİİİİİ.org/İİ"), (9, "http://İİİİİİ.org/İİ"), (10, "http://" + "a-1/" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({n: F.lit(1) for n in ("score", "id", "host", "path", "bin", "signs", "digit")})
    got = sorted(((r["page_id"] or 0, r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in url_filter.judge(pages, URL_RULES).collect()))
    assert [r[:4] for r in got] == [
        (0, "x.org", "/ü😀", None), (1, "www.example.com", "/en/1", "www.example.com/en/"), (2, "a.example.com", "/en/2", "example.com/en/"), (3, "x.com", "/", "com/"), (4, "x.com", "", None),
        (5, "", "", None), (6, "", "", None), (7, "b.net", "/es/x", "net/es/"), (8, "b.net", "/de/x", None), (8, "b.net", "/de/x", None), (9, "İİİİİİ.org", "/İİ", None), (9, "İİİİİİ.org", "/İİ", None), (10, "a-1", "/a-1/a-1/", None),
    ]
    assert {r[4] for r in got} <= {"allow", "block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_url_filter_on_held_out_urls(spark):
    rng = random.Random(32)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    urls = [f"http://{word('abcde')}.com/{word('abcde')}" for _ in range(300)] + [f"http://{word('vwxyz')}.net/es/{word('vwxyz')}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert url_filter.accuracy(pages, URL_RULES) > 0.95
    new = spark.createDataFrame([(0, "http://abcab.org/deabc"), (1, "http://zyxwv.org/vwxyz")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages.unionByName(new.withColumn("page_id", F.col("page_id") + 1000)), URL_RULES).collect()}
    assert (got[1000], got[1001]) == ("allow", "block")
    assert url_filter.accuracy(pages.limit(0), URL_RULES) is None


def test_pii(spark, awkward, empty):
    text = "write to a.b+c@mail.example.com, host 10.0.0.255 and 1.2.3.256, card 4111 1111 1111 1111 or 4111 1111 1111 1112; ☎ +49 (0)30 1234567. IBAN DE89 3704 0044 0532 0130 00 or DE88370400440532013000, token = \"abcdefghij0123456789xyz\""
    docs = spark.createDataFrame([(1, text), (2, "a@b" + ".c" * 50_000), (3, "1" * 200_000 + " " + "1 " * 50_000), (4, "x@y.zz " * 3_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [
        ("email", "a.b+c@mail.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (0)30 1234567"), ("iban", "DE89 3704 0044 0532 0130 00"), ("secret", "abcdefghij0123456789xyz")
    ]
    assert [got[i]["n_email"] for i in (2, 3, 4)] == [1, 0, 3_000] and got[4]["spans"].endswith("email:20993:20999")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "[EMAIL], host [IP] and 1.2.3.256, card [CARD] or 4111 1111 1111 1112; ☎ [PHONE]. IBAN [IBAN] or DE88" in clean[1] and '"[SECRET]"' in clean[1]
    assert clean[4] == "[EMAIL] " * 3_000 and clean[3] == "1" * 200_000 + " " + "1 " * 50_000
    assert pii.detect(awkward).count() == awkward.count() and pii.redact(awkward).columns == awkward.columns
    assert pii.detect(empty).count() == 0 and pii.redact(empty).count() == 0


def test_context_decides(spark):
    token, iban = "Abcdefghij0123456789xyz", "DE89370400440532013000"
    cases = [("access token " + token, 1), ("see " + token, 0), ("sample token " + token, 0), ("commit " + token, 0), ("see " + iban, 1), ("for example " + iban, 0), ("account, for example " + iban, 1), ("token " + token.replace("0123456789", "abcdefghij"), 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert [got[i] != "" for i in range(len(cases))] == [bool(n) for _, n in cases]


def brute_redacted(text, spans):
    out, at = "", 0
    for start, back, kind in sorted((int(a), -int(b), k.upper()) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, -back)
    return out + text[at:]


def test_redaction_leaves_nothing(spark):
    """Spans that overlap go together; the text between stays as it is; spans are those of the original."""
    rng = random.Random(31)
    parts = ["+12 10.0.0.1 34567", "a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "token 4111111111111111abcdefgh", "+49 301 234 567@x.org", "ü😀", "x" * 5_000, " ", "\n"]
    texts = ["call +12 10.0.0.1 34567 now", None, ""] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"row": F.lit(1), "pii_email": F.lit("x"), "spans": F.lit(2)})
    got, spans = ({r["doc_id"]: r for r in df.collect()} for df in (pii.redact(docs), pii.detect(docs)))
    assert got[0]["text"] == "call [PHONE] now" and got[1]["text"] is None and got[0]["pii_email"] == "x" and got[0]["spans"] == 2
    assert all(got[i]["text"] == brute_redacted(t, spans[i]["spans"]) for i, t in enumerate(texts) if t is not None)


def test_running_totals_of_long_arrays(spark):
    from splicework.llm.common import running_total

    rows = spark.createDataFrame([([i % 7 for i in range(n)],) for n in (0, 1, 255, 256, 257, 2000)], "v array<int>")
    for r in rows.select("v", running_total(F.col("v")).alias("t")).collect():
        assert r["t"] == np.cumsum(r["v"]).tolist()


def brute_mix(rows):
    """rows: (id, source, size); the words taken of each row, slot by slot along the schedule. Ids are not null."""
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    stream = {s: [i for _, _, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), n, k) for k, (i, x, n) in enumerate(rows) if x == s for _ in range(n))] for s in names}
    want = mixing.targets([len(stream[s]) for s in names])
    edges = mixing.edges(want)
    slots = collections.defaultdict(int)
    for i in range(mixing.slots_of(len(names))):
        point = i * mixing.GOLDEN % mixing.MODULUS
        slots[next(k for k, lo, hi in edges if lo <= point < hi)] += 1
    taken = [0] * len(rows)
    for k, s in enumerate(names):
        goal, size = int(want[k] + Fraction(1, 2)), len(stream[s])
        n = max(1, slots[k] * size // goal) if goal else 0
        for r in range(slots[k] if goal else 0):
            for word in stream[s][r % n * size // n : (r % n + 1) * size // n]:
                if goal:
                    taken[word] += 1
                    goal -= 1
        assert goal == 0 or not size
    return taken


def test_mixing(spark, awkward, empty):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(awkward.repartition(7)).collect()), key=str)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, target = collections.Counter(), {}
    for r in mixing.with_taken(docs).select("source", "mix_taken", "mix_target").collect():
        taken[r["source"]] += r["mix_taken"]
        target[r["source"]] = r["mix_target"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert mixing.mix(empty).count() == 0 and mixing.with_taken(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (1, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


def test_mixing_against_brute_force(spark):
    rng = random.Random(33)
    rows = [(i, rng.choice(["hot"] * 20 + ["a", "b", "b", "c", None]), rng.choice([0, 1, 3, 50, 400])) for i in range(300)] + [(1000, "one", 1), (1001, "ten", 10)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, s, n in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert [got[i] for i, _, _ in rows] == brute_mix(rows)


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_source", "_name", "_span", "_digest", "_from", "_to", "_block", "size", "taken", "row", "id", "name", "tie", "mix_size", "target"]
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    got = mixing.with_taken(docs)
    assert got.columns == [c for c in docs.columns if c != "mix_size"] + ["mix_size", "mix_source_size", "mix_target", "mix_taken"]
    assert {r["doc_id"]: (r["mix_size"], r["size"], r["_from"]) for r in got.collect()} == {1: (2, "size", "_from"), 2: (1, "size", "_from")}
    assert mixing.mix(docs).count() == 2


def test_mixing_meets_targets_of_any_size(spark):
    """Sources from 10 words to 4,000,000: the smallest ones reach their targets too."""
    rows = [(i, "w " * 10_000, "hot") for i in range(400)] + [(1000 + i, "w " * 10, f"s{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    small = next(r for r in got if r["source_size"] == 10)
    assert (small["target"], small["taken"], small["n"]) == (20.0, 120, 6)
    assert all(abs(r["taken"] - r["target"]) <= 0.5 for r in got if r["source_size"] > 10)


def test_mix_meets_small_targets(spark):
    """One hot source and a tail of small ones; each gets its target, rounded."""
    rng = random.Random(22)
    rows = [(i, "w " * 2000, None, "hot", None) for i in range(3000)]
    rows += [(10_000 + 100 * s + k, "w " * rng.choice([1, 5, 10 ** (s % 4)]), None, f"tail{s:03}", None) for s in range(120) for k in range(1 + s % 10)]
    sizes = {i: (s, len(t.split())) for i, t, _, s, _ in rows}
    taken, target = collections.Counter(), {}
    for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOCS), SF).collect():
        source, size = sizes[r["doc_id"]]
        assert r["size"] == size and 0 <= r["taken"] <= 2 * size
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert len(target) == 121 and all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_targets():
    assert mixing.targets([100, 100, 100]) == [Fraction(200), Fraction(250, 3), Fraction(500, 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert sum(mixing.targets([5, 1000, 7, 300])) == 1.5 * 1312


def test_pipeline(spark):
    """Each stage's rows against a brute-force version of it on what the stage before kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    items = [set(decontaminate.shingles((r["text"] or "").encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["classify", "deduplicate", "decontaminate", "redact", "mix"]
    kept = sorted(corpus_pipeline.classify(spark, docs, sf).collect(), key=lambda r: r["doc_id"])
    assert len({r["doc_id"] for r in kept} & bad) <= 1 and len(kept) > 0.7 * docs.count()
    comp = brute_near([r["text"] for r in kept])
    left = [r for i, r in enumerate(kept) if comp[i] == i]
    left = [r for r in left if not any(s and len(s & set(decontaminate.shingles((r["text"] or "").encode()))) >= 0.8 * len(s) for s in items)]
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    clean = [(r["doc_id"], r["source"], brute_redacted(r["text"], spans[r["doc_id"]])) for r in left]
    assert set(got) == {i for i, _, _ in clean} and all(got[i]["text"] == t and got[i]["source"] == s for i, s, t in clean)
    assert [got[i]["taken"] for i, _, _ in clean] == brute_mix([(i, s, len(t.split())) for i, s, t in clean])


def test_stages_on_awkward_tables(spark, awkward, empty):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables go through every stage."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] + [(None, 1), (5, None)], "doc_id long, quality int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, awkward, SF)
        assert got.columns[: len(awkward.columns)] == awkward.columns or name == "mix"
        assert got.count() == (7 if name == "deduplicate" else awkward.count())
        assert stage(spark, empty, SF).count() == 0
    model = quality.fit(awkward, labels)
    assert quality.scored(awkward, model).count() == awkward.count()
    assert corpus_pipeline.classify(spark, empty, SF).count() == 0