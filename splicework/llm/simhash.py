"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two are linked at DISTANCE (4) or fewer differing bits. It is cut into three
segments of 22, 21 and 21 bits, each a word of the perfect (23, 12) Golay code with its last bits 0. Every
23-bit word has one codeword within three bits, whose index is its key; the words one bit away decode to
six indices at most. By pigeonhole, of 4 errors in three segments some two segments have 2 or fewer
together: (1, 1), (0, 2) or (2, 0) at worst. A word one error from each of the two fingerprints lies halfway
between them, so they share a key if each has the keys of all words within one bit over both segments: up
to 11 pairs of indices for each of the three choices of two segments, 33 keys of 24 bits a fingerprint.

Fingerprints that share a key are compared exactly. Within a key, links are searched breadth first: each
fingerprint that is reached is compared only with those not reached yet. So a large group of near copies
costs little more than one comparison each and gives a spanning tree of its links, not all pairs, and no
link between groups is lost. Copies of a fingerprint are one node throughout.

Components: alternating large-star and small-star steps, each a table in the shared folder.

Null texts count as empty; texts without words have fingerprint zero and are linked like others. Rows with
null ids get a fingerprint and a component, which is null if no id is reachable. Repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import written

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Of each segment: lowest bit, bits. Then the choices of two segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHOICES = ((0, 1), (0, 2), (1, 2))
#: The Golay code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Keys of up to so many fingerprints are compared pair by pair, all keys of a batch at once.
SMALL = 16


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the hashes of the text's SHINGLE-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = min(SHINGLE, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=False)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _corrections() -> np.ndarray:
    """Of each remainder, the error of three bits or fewer that has it."""
    bits = 1 << np.arange(23)
    errors = np.unique(np.concatenate([[0], bits, (bits[:, None] | bits).ravel(), (bits[:, None, None] | bits[:, None] | bits).ravel()]))
    table = np.zeros(2048, dtype=np.int64)
    table[_remainder(errors)] = errors
    return table


_ERROR = _corrections()


def index(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[_remainder(words)]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints (uint64): choice of segments, and the two indices."""
    own, near = [], []
    for low, n in SEGMENTS:
        word = (prints >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64)
        own.append(index(word))
        ball = np.sort(np.stack([own[-1], *(index(word ^ (1 << k)) for k in range(n))], axis=1), axis=1)
        ball[:, 1:][ball[:, 1:] == ball[:, :-1]] = -1
        near.append(ball)
    rows, found = [], []
    for c, (i, j) in enumerate(CHOICES):
        for ball, at, fixed in ((near[i], 12, own[j]), (near[j], 0, own[i] << 12)):
            r, k = np.nonzero(ball >= 0)
            rows.append(r)
            found.append((c << 24) | (ball[r, k] << at) | fixed[r])
    row, key = np.concatenate(rows), np.concatenate(found)
    once = np.unique(row << 26 | key)
    return once >> 26, once & ((1 << 26) - 1)


def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys: all of small runs, a spanning forest of each larger run."""
    start = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(start, append=len(key))
    left, right = [], []
    group = np.repeat(np.arange(len(start)), size)
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= DISTANCE]
        left.append(fp[i])
        right.append(fp[i + d])
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        a, b = spanning(fp[s : s + n])
        left.append(a)
        right.append(b)
    return np.concatenate([*left, fp[:0]]), np.concatenate([*right, fp[:0]])


def spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints, breadth first over those not reached yet."""
    rest, left, right = fp, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= DISTANCE
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    return np.concatenate([*left, fp[:0]]), np.concatenate([*right, fp[:0]])


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = np.array([fingerprint(t.as_py() or b"") for t in b.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fp"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = b.column(0).to_numpy()
        row, key = keys(own.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["key", "fp"])


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their keys; the last key's rows of a batch wait for the next."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = links(k, f.view(np.uint64))
        pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
        if len(key) and key[0] != key[-1]:
            cut = np.searchsorted(key, key[-1])
            yield out(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield out(key, fp)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_print_rows, "doc_id long, fp long")


def find_links(prints: DataFrame) -> DataFrame:
    """a, b: links between different fingerprints of a column fp of distinct fingerprints, enough to connect all that are linked."""
    keyed = prints.select("fp").mapInArrow(_key_rows, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_rows, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of edges a, b."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    last = None
    while True:
        # large star: each larger neighbour of a node goes to its least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each smaller neighbour of a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, fp, component_id (the least doc_id reachable)."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(find_links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
