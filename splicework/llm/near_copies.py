"""SimHash near-dedup at a similarity: Golay-code fuzzy hashing of five-word shingles, verified exactly.

Two texts are linked if SHARED (0.8) or more of their shingles are common: Jaccard similarity of the sets of runs of
WORDS (5) words, lower-cased; a shorter text is one shingle. Texts of equal shingle sets are one node throughout, so
all null and blank texts are copies of each other.

Fingerprint: BITS (256) sums, over the set, of +1 or -1 by a bit of each shingle's hash; the bits are the sums' signs. At a
similarity of 0.8 some 39 of 256 bits differ, far beyond what a search by few errors reaches. So segments are decoded
softly: each of SEGMENTS (5) segments of 23 sums goes to the NEAR (4) codewords of the (23, 12) Golay code with the
greatest inner products, as bits that differ are mostly those whose sums were small. Two texts of similarity 0.8 have a
codeword of a segment in common with probability 0.848 (simulated; 0.92 at 0.85, 0.97 at 0.9). By pigeonhole over
segments, texts that agree in two segments or more share one of the 160 keys (two segments, a codeword of each):
0.998 at 0.8 and 0.9998 at 0.85. That, and the limits below (1e-5), is all that can be missed.

Candidates are pairs that share a key, differ in FIRST (40) or fewer of the first 128 bits, and in FAR (66) or fewer of all;
unrelated texts that share a key differ in about 117. Clusters are the components of the candidates; keys of the first choice are
looked up first, and those of all others only between texts that these left apart. Within a cluster all
links are found on exact shingle sets, so no pair below SHARED links, and no link is lost to a cap.

Scale. Keys have 24 bits and a choice of 10, so unrelated texts share one at 1.5e-4 of all pairs, a comparison of two
words each; key rows hold the first 128 bits, 20 bytes in all. Those of one key meet in one task: 24 bytes each, and a
dense key costs little more than a comparison each. A cluster is searched breadth first by an inverted index of its
shingles; one of more than BLOCK bytes of text is dealt to blocks at random, twice, which joins what is dense; what then
lies outside its cluster's largest component is compared with all blocks. So a task holds two blocks at most (or a
longer text), and a cluster of any size is split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import ROW, numbered, written
from splicework.llm.simhash import GENERATOR, components
from splicework.llm.textarrays import mix, shingle_hashes, word_hashes

WORDS, SHARED, SEED = 5, (4, 5), 42
BITS, SEGMENTS, NEAR, FIRST, FAR, BLOCK = 256, 5, 4, 40, 66, 4 << 20
CHOICES = [(i, j) for i in range(SEGMENTS) for j in range(i)]
KEYS = len(CHOICES) * NEAR * NEAR
#: Keys of up to so many fingerprints are compared pair by pair, all keys of a batch at once.
SMALL = 16
_SALTS = np.random.default_rng(SEED).integers(0, 2**64, BITS // 64, dtype=np.uint64)


def _codewords() -> np.ndarray:
    """Those of the code's 4096 words that have their highest bit clear, as rows of +1 and -1; the others are their complements."""
    words = np.arange(2048) << 11
    low = words.copy()
    for bit in range(22, 10, -1):
        low = np.where(low >> bit & 1, low ^ (GENERATOR << (bit - 11)), low)
    return ((words ^ low)[:, None] >> np.arange(23) & 1) * 2.0 - 1.0


_CODE = _codewords()


def shingles(text: bytes) -> np.ndarray:
    """Digests of the text's distinct shingles, in order."""
    return np.unique(shingle_hashes(word_hashes(text)[0], WORDS))


def sums(hashes: np.ndarray) -> np.ndarray:
    """The BITS sums of +1 and -1."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14), None] ^ _SALTS
        total += np.unpackbits(mix(part).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total - len(hashes)


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """Of rows of sums, rows of BITS / 64 words."""
    return np.packbits(totals > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1, BITS // 64)


def keys(totals: np.ndarray) -> np.ndarray:
    """KEYS keys of each row of sums: a choice of two segments, and the index of one of the NEAR codewords of each."""
    near = np.empty((len(totals), SEGMENTS, NEAR), np.int64)
    for at in range(0, len(totals), 128):
        fit = totals[at : at + 128, : SEGMENTS * 23].reshape(-1, 23).astype(np.float64) @ _CODE.T
        best = np.sort(np.argpartition(np.abs(fit), -NEAR, axis=1)[:, -NEAR:], axis=1)
        near[at : at + 128] = (best | (np.take_along_axis(fit, best, axis=1) < 0) << 11).reshape(-1, SEGMENTS, NEAR)
    out = [(c << 24 | near[:, i, :, None] << 12 | near[:, j, None, :]).reshape(-1, NEAR * NEAR) for c, (i, j) in enumerate(CHOICES)]
    return np.concatenate(out, axis=1).reshape(-1, KEYS)


def alike(shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Whether sets of a and b shingles with so many in common have a similarity of SHARED or more."""
    return shared * SHARED[1] >= SHARED[0] * (a + b - shared)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def candidates(key: np.ndarray, fp: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of FIRST bits or fewer within each run of equal keys: all of small runs, a spanning forest of each larger one.

    Those of one root are connected already: no pair has one root, and a forest reaches all of a root's members by the nearest of them.

    A forest grows from the fingerprint nearest to the run's majority bits on, always at the nearest that is reached: most of
    a large group hangs on few fingerprints in its middle, the same in all its keys, so that it has few pairs a member."""
    start = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(start, append=len(key))
    group, small = np.repeat(np.arange(len(start)), size), np.repeat(size <= SMALL, size)
    root = np.arange(len(key)) if root is None else root
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d] & (root[:-d] != root[d:]))
        i = i[_distance(fp[i], fp[i + d]) <= FIRST]
        left.append(i)
        right.append(i + d)
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        own = fp[s : s + n]
        ones = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        run = s + np.lexsort((print_id(own), _distance(own, np.packbits(2 * ones > n).view(np.uint64))))
        _, own_root = np.unique(root[run], return_inverse=True)
        rest = np.arange(n)
        while len(rest):
            first = own_root[rest] == own_root[rest[0]]
            queue, rest = rest[first].tolist(), rest[~first]
            while queue and len(rest):
                x = heapq.heappop(queue)
                apart = _distance(fp[run[rest]], fp[run[x]])
                near = rest[np.argsort(apart, kind="stable")[: (apart <= FIRST).sum()]]
                if len(near):
                    roots, one = np.unique(own_root[near], return_index=True)  # the nearest of each
                    left.append(np.full(len(one), run[x]))
                    right.append(run[near[one]])
                    found = np.isin(own_root[rest], roots)
                    for i in rest[found].tolist():
                        heapq.heappush(queue, i)
                    rest = rest[~found]
    return np.concatenate(left), np.concatenate(right)


def links(sets: list[np.ndarray], group: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of alike sets that connect all groups with alike members; what is in one group counts as connected."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], group, "left")
    last = np.searchsorted(group[by_group], group, "right")
    open_, out = np.ones(len(sets), bool), []

    def reach(i: int) -> list[int]:
        """All of i's group that are open; they are not open any more."""
        found = [j for j in by_group[first[i] : last[i]].tolist() if open_[j]]
        open_[found] = False
        return found

    for root in range(len(sets)):
        if not open_[root]:
            continue
        queue = reach(root)
        while queue and open_.any():
            x = queue.pop()
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            n = hi - lo
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
            shared = np.bincount(owner[places], minlength=len(sets))
            for j in np.flatnonzero(open_ & alike(shared, sizes, len(sets[x]))).tolist():
                if open_[j]:
                    out.append((x, j))
                    queue.extend(reach(j))
    return out


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            sets = [shingles(t.as_py() or b"") for t in part.column(1)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            totals = np.array([sums(s) for s in sets], dtype=np.int64).reshape(-1, BITS)
            fp = fingerprints(totals).view(np.int64)
            found = pa.ListArray.from_arrays(np.arange(0, len(sets) * KEYS + 1, KEYS, dtype=np.int32), pa.array(keys(totals).astype(np.int32).reshape(-1)))
            columns = [part.column(0), node, print_id(fp.view(np.uint64)), *(fp[:, i].copy() for i in range(4)), found]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["_row", "node", "fp", "f0", "f1", "f2", "f3", "keys"])


def print_id(fp: np.ndarray) -> np.ndarray:
    """A number for the first 128 bits of fingerprints."""
    return mix(mix(fp[:, 0]) + fp[:, 1]).view(np.int64)


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows key, f0, f1, root (null: none) in order of their keys, candidates a, b; the last key's rows of a batch wait for the next."""
    held = np.empty((0, 4), np.int64)

    def out(rows: np.ndarray) -> pa.RecordBatch:
        fp = np.ascontiguousarray(rows[:, 1:3]).view(np.uint64)
        i, j = candidates(rows[:, 0], fp, np.where(rows[:, 3] == 0, print_id(fp), rows[:, 3]))
        a, b = print_id(fp[i]), print_id(fp[j])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        held = np.concatenate([held, np.stack([pc.fill_null(c, 0).to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
        if len(held) and held[0, 0] != held[-1, 0]:
            cut = np.searchsorted(held[:, 0], held[-1, 0])
            yield out(np.ascontiguousarray(held[:cut]))
            held = held[cut:]
    if len(held):
        yield out(held)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of rows part, node, root, text in order of their parts."""
    now, node, root, sets = None, [], [], []

    def out() -> pa.RecordBatch:
        _, group = np.unique(np.array(root, dtype=np.int64), return_inverse=True)
        found = links(sets, group)
        return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for part, n, r, t in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
            if part != now:
                if len(node) > 1:
                    yield out()
                now, node, root, sets = part, [], [], []
            node.append(n)
            root.append(r)
            sets.append(shingles(t.as_py() or b""))
    if len(node) > 1:
        yield out()


def _linked(rows: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Links within each part (the columns parts) of rows with node, root and text."""
    part = F.concat_ws(" ", *parts).alias("part")
    dealt = rows.select(part, "node", "root", "text").repartition("part").sortWithinPartitions("part", "node")
    return written(dealt.mapInArrow(_link_rows, "a long, b long"), name)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with root: the component of node."""
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def contracted(edges: DataFrame) -> DataFrame:
    """node, root of edges a, b, as components() gives: first along each node's least neighbour alone, one edge a node, then between what that leaves.

    A large group has several edges a node; the rounds of components() then deal out one of them."""
    own = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near-edges")
    return extended(written(components(own.groupBy("a").agg(F.min("b").alias("b"))), "near-roots"), own)


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, root) after more edges a, b: only edges between different roots take part in the rounds."""
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    left = edges.select("a", "b").join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b").distinct()
    second = written(components(left).select(F.col("node").alias("root"), F.col("root").alias("top")), "near-tops")
    moved = roots.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = second.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return written(moved.unionByName(new), "near-roots")


def grouped(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """_row, root (equal for all rows of a component) of rows with a stable key _row."""
    own = rows.select("_row", F.col(text_col).cast("binary").alias("text"))
    columns = "_row long, node long, fp long, f0 long, f1 long, f2 long, f3 long, keys array<int>"
    prints = written(own.mapInArrow(_print_rows, columns), "near-prints")
    bits = prints.groupBy("fp").agg(*(F.min_by(c, "_row").alias(c) for c in ("f0", "f1", "f2", "f3")))
    sides = [bits.select(F.col("fp").alias(s), *(F.col(c).alias(f"{s}{c}") for c in ("f0", "f1", "f2", "f3"))) for s in "ab"]
    far = sum(F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in ("f0", "f1", "f2", "f3"))

    def near(some: Column, roots: DataFrame | None = None) -> DataFrame:
        """Candidates by some of the keys, but not between fingerprints of one root."""
        each = prints.groupBy("fp").agg(F.min_by(F.struct("f0", "f1", some.alias("keys")), "_row").alias("p"))
        known = each.withColumn("root", F.lit(None).cast("long")) if roots is None else each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
        keyed = known.select(F.explode("p.keys").alias("key"), "p.f0", "p.f1", "root")
        pairs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_candidate_rows, "a long, b long").distinct()
        return pairs.join(sides[0], "a").join(sides[1], "b").where(far <= FAR).select("a", "b")

    # most of a large group hangs together by the keys of one choice; all others then have few pairs to give
    clusters = contracted(near(F.slice("keys", 1, NEAR * NEAR)))
    clusters = extended(clusters, near(F.slice("keys", NEAR * NEAR + 1, KEYS), clusters))
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    # nodes of a cluster, or of one fingerprint; their texts, and the number of blocks of their cluster
    nodes = prints.groupBy("node").agg(F.min("_row").alias("_row"), F.min("fp").alias("fp")).join(clusters, "fp", "left")
    nodes = nodes.select("node", "_row", F.coalesce("cluster", "fp").alias("cluster"))
    some = nodes.join(nodes.groupBy("cluster").count().where("count > 1").select("cluster"), "cluster")
    texts = written(own.join(some, "_row").select("node", "cluster", F.col("node").alias("root"), "text"), "near-texts")
    blocks = texts.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("text") + 64) / BLOCK).alias("blocks"))
    texts = texts.join(blocks, "cluster")

    def block(turn: int):
        return F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("blocks"))

    roots = contracted(_linked(texts.withColumn("block", block(1)), ["cluster", "block"], "near-links"))
    large = texts.where("blocks > 1")
    if large.isEmpty():
        return _final(prints, roots)
    roots = extended(roots, _linked(_rooted(large, roots).withColumn("block", block(2)), ["cluster", "block"], "near-links"))
    # what is outside its cluster's largest component meets all blocks
    placed = written(_rooted(large, roots), "near-rooted")
    size = placed.groupBy("cluster", "root").count()
    most = size.groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("n")).where("n > 1").select("cluster", F.col("most.root").alias("largest"))
    left = placed.join(most, "cluster").withColumn("outside", F.col("root") != F.col("largest"))
    n_left = left.where("outside").groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("text") + 64) / BLOCK).alias("lefts"))
    left = left.join(n_left, "cluster").withColumns({"block": block(3), "mine": F.pmod(F.xxhash64(F.lit(4), "node"), F.col("lefts"))})
    each = left.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)))
    inside = each.where("not outside").select("cluster", "block", "with", "node", "root", "text")
    outside = left.where("outside").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("cluster", "block", F.col("mine").alias("with"), "node", "root", "text")
    # of those outside, also one another's: each as a guest in its own block
    guests = each.where("outside and mine != with").select("cluster", "block", "with", "node", "root", "text")
    return _final(prints, extended(roots, _linked(inside.unionByName(outside).unionByName(guests), ["cluster", "block", "with"], "near-links")))


def _final(prints: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(prints.select("_row", "node"), roots).select("_row", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the least id, rows without ids last; then by digest of the text.

    Rows are judged by a key of their own, so null and repeated ids do no harm; an empty table gives no rows; other
    columns, of any name, are kept."""
    rows = numbered(docs, "near-rows")
    own = rows.select(F.col(ROW).alias("_row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"))
    own = own.join(grouped(rows.select(F.col(ROW).alias("_row"), text_col), text_col), "_row")
    own = written(own.select("_row", "root", F.struct(F.col("id").isNull().alias("none"), "id", "tie", "_row").alias("place")), "near-groups")
    first = own.groupBy("root").agg(F.min("place").alias("first"))
    drop = own.join(first, "root").where("_row != first._row").select(F.col("_row").alias(ROW))
    return rows.join(drop, ROW, "left_anti").select(*docs.columns)
