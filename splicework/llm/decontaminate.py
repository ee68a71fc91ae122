"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Documents are the indexed sets, test items the queries, both of SHINGLE-word shingles. A document may be thousands of
times as long as an item, so a sketch of one fixed size cannot see the item: both sides fall into size partitions
(powers of two), and for a pair of partitions a document's sketch is a one-permutation MinHash whose number of bins
follows from both: so many that a shingle of the document is its bin's minimum with probability s, where EXPECT (12) of
an item's shingles are to be seen at a containment of CONTAINED (0.8). A long item needs a sparse sketch (s = 0.12 at
129 shingles), a short one nearly all minima (s = 0.9999 at 12). Bins are not stored: the minimum of a bin is the first
of the document's sorted hashes with its high bits.

Of an item with q shingles, X are minima of a document that contains ceil(0.8 q) of them, X binomial with s. The item is a
candidate if X or more are seen than a binomial variable falls short of with probability MISS (1e-4): that is the
threshold by size, and the chance to lose a pair at exactly 0.8. Each candidate is verified by its exact shingles as text.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Repeated shingles count
once. A text of fewer than SHINGLE words has one shingle, of all its words; one without words has none and
never matches.

Scale: documents are read and hashed once, in place, without a shuffle, whatever the number of items; only matches
leave the task. Items stream through the driver into blocks of about BLOCK shingles, each a broadcast of bounded size;
a task holds some documents' hashes (CHUNK bytes of text, or one longer text) and one block at a time.

Null texts count as empty; null ids are reported as null; repeated rows of either table give a row each; ties do not
arise, as a row's result depends on its own text and item alone. Empty tables give no rows. Other columns of either
table, of any name, are not touched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import ROW, numbered
from splicework.llm.textarrays import ALNUM, LOWER, mix, shingle_hashes, word_hashes

SHINGLE, CONTAINED, EXPECT, MISS, BLOCK, CHUNK = 5, 0.8, 12, 1e-4, 1_000_000, 16 << 20
_CLEAN = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingles(text: bytes) -> list[bytes]:
    words = text.translate(_CLEAN).split(b" ")
    words = [w for w in words if w]
    n = min(SHINGLE, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def size_class(n: int) -> int:
    """The least c with n <= 2 ** c."""
    return max(0, int(n - 1).bit_length())


@lru_cache(None)
def survival(k: int) -> float:
    """The probability s for items of class k, by the least size in it."""
    least = 2 ** (k - 1) + 1 if k else 1
    return min(1 - 1e-4, EXPECT / ceil(CONTAINED * least))


@lru_cache(None)
def extra_bits(k: int) -> int:
    """Bins are 2 ** (c + extra_bits(k)) for documents of class c: at a load of x shingles a bin, (1 - exp(-x)) / x of them are minima."""
    low, high = 1e-6, 1e6
    for _ in range(100):
        x = (low * high) ** 0.5
        low, high = (x, high) if (1 - exp(-x)) / x > survival(k) else (low, x)
    return ceil(-log2(low))


@lru_cache(None)
def threshold(q: int) -> int:
    """How many minima of an item of q shingles have to be seen."""
    n, s = ceil(CONTAINED * q), survival(size_class(q))
    p = below = (1 - s) ** n
    t = 0
    while below <= MISS and t < n:
        t += 1
        p *= (n - t + 1) / t * s / (1 - s)
        below += p
    return max(1, t)


def minima(ordered: np.ndarray, k: int) -> np.ndarray:
    """The sketch of a set of hashes, in order, for items of class k."""
    bits = size_class(len(ordered)) + extra_bits(k)
    if bits <= 0 or bits >= 64:
        return ordered[: 1 if bits <= 0 else None]
    bins = ordered >> np.uint64(64 - bits)
    return ordered[np.append(True, bins[1:] != bins[:-1])]


def hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle in order: its hash, and its first byte's place."""
    words, places = word_hashes(text, ALNUM)
    found = mix(shingle_hashes(words, SHINGLE) ^ _SALT)
    return found, places[: len(found)]


class Items:
    """A block of items."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.rows, self.sets = rows, [np.unique(hashes(t)[0]) for _, t in rows]
        self.least = np.array([threshold(len(h)) for h in self.sets], dtype=np.int64)
        self.exact: dict[int, frozenset] = {}
        classes = np.array([size_class(len(h)) if len(h) else -1 for h in self.sets], dtype=np.int64)
        self.tables = []
        for k in np.unique(classes[classes >= 0]).tolist():
            which = np.flatnonzero(classes == k)
            values = np.concatenate([self.sets[i] for i in which])
            order = np.argsort(values)
            some = np.zeros(1 << 20, dtype=bool)  # by a value's first 20 bits: whether any item may have it
            some[(values >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((k, values[order], np.repeat(which, [len(self.sets[i]) for i in which])[order], some))

    def candidates(self, ordered: np.ndarray) -> list[int]:
        """Items that a document with these hashes, in order, may contain."""
        out = []
        for k, values, which, some in self.tables if len(ordered) else []:
            own = minima(ordered, k)
            own = own[some[(own >> np.uint64(44)).astype(np.int64)]]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            if n.any():
                places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                items, seen = np.unique(which[places], return_counts=True)
                out += items[seen >= self.least[items]].tolist()
        return sorted(out)

    def contained(self, text: bytes, ordered: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """(item id, its shingles, how many of them the text has) where that is CONTAINED of them or more."""
        found = self.candidates(ordered)
        if not found:
            return
        each, places = hashes(text)
        for i in found:
            if i not in self.exact:
                self.exact[i] = frozenset(shingles(self.rows[i][1]))
            own = set()
            for p in np.flatnonzero(np.isin(each, self.sets[i])).tolist():
                end = places[p + SHINGLE] if p + SHINGLE < len(places) else len(text)
                own.update(shingles(text[places[p] : end])[:1])
            shared = len(self.exact[i] & own)
            if shared >= CONTAINED * len(self.exact[i]):
                yield self.rows[i][0], len(self.exact[i]), shared


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items, a partition at a time, in blocks of 2 * BLOCK bytes of text: BLOCK shingles at most."""
    block, held = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], bytes(r["text"])))
        held += len(block[-1][1])
        if held > 2 * BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text") -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, n_shingles, n_shared, containment."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_col).cast("binary"), F.lit(b"")).alias("text"))
    blocks = [docs.sparkSession.sparkContext.broadcast(pickle.dumps(b)) for b in _blocks(tests)]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        some, held = [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or b""
                some.append((d, text, np.unique(hashes(text)[0])))
                held += len(text)
                if held > CHUNK:
                    yield some
                    some, held = [], 0
        if some:
            yield some

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for some in chunks(batches):
            for sent in blocks:
                if block is None or len(blocks) > 1:
                    block = Items(pickle.loads(sent.value))  # the broadcast keeps bytes only, so that one block is unpacked at a time
                rows = [{"doc_id": d, "item_id": i, "n_shingles": n, "n_shared": m} for d, text, ordered in some for i, n, m in block.contained(text, ordered)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    found = own.mapInArrow(matches, "doc_id long, item_id long, n_shingles long, n_shared long")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text") -> DataFrame:
    """The rows that contain no item, with all their columns; each row is judged by its own text, whatever its id."""
    rows = numbered(docs, "decontaminate-rows")
    bad = search(rows, items, ROW, text_col, item_id_col, item_col).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)
