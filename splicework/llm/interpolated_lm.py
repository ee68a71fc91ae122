"""Language-model scoring by deleted interpolation.

A token's probability after its context u (the token before; the end sign before the first) is
    w2[b] * c(u v) / c(u) + w1[b] * c(v) / N + w0[b] / (V + 1),
b the bucket of c(u) by powers of two. The weights of each bucket come from expectation-maximisation on
held-out counts: each training document's tokens, with the document's own counts deleted from all others'.
All training tokens take part: they are first summed by bucket and by cells of the two probabilities, CELLS a decade,
each cell with its tokens' number and their mean log-probabilities (means, not the cells' middles: what is lost is of
second order in a cell's width); a table whose size does not grow with the data. EM runs on that table.

Counting. Rows are dealt to blocks of about BLOCK bytes by a hash of id, text and place, so repeated rows do not meet in
one. A block sends each of its distinct n-grams once,
as a 64-bit hash with its count in training documents, packed by range of the hash (a shard); a shard adds
up the counts and sends each block its totals back. A block never has more than its documents hold, a hot
word or pair is one entry a block, and all that moves is n-grams per block: at most one row a shard, never more rows
than n-grams, many rows in one batch. Then a document's tokens meet
their counts in its block, kept as a table of counts per token, from which EM and the scores are computed.

Tokens are lower-cased (A-Z) words, then one end sign. Null texts count as empty: one token, the end. Rows with
null ids are in no fold and are learned from; repeated rows get a row each, and are counted each. An empty
table gives no rows. With no training tokens, every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import fold, written
from splicework.llm.textarrays import mix, word_hashes

BLOCK, SHARD, PARTITIONS, STEPS, CELLS, NONE = 12 << 20, 16 << 20, 20_000, 60, 20, 1023
#: Bytes of rows of shards that are sent in one batch.
BATCH = 4 << 20
END = np.uint64(0x2545F4914F6CDD1C)
_ONE, _ODD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words and of the end, even numbers."""
    return np.append(word_hashes(text)[0], END) & ~_ONE


def pairs(unigrams: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it, odd numbers; the end sign stands before the first."""
    before = np.concatenate([[END & ~_ONE], unigrams[:-1]])
    return mix(before * _ODD + unigrams) | _ONE


class Block:
    """The tokens of some documents, and their distinct n-grams in order."""

    def __init__(self, texts: list[bytes | None], held: np.ndarray):
        each = [tokens(t or b"") for t in texts]
        self.sizes = np.array([len(t) for t in each], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        every = np.concatenate([*each, *(pairs(t) for t in each)])
        del each
        order = np.argsort(every)
        every = every[order]
        first = np.diff(every, prepend=~every[:1]) != 0
        self.grams, self.held = every[first], held
        at = np.empty(len(every), np.int64)
        at[order] = np.cumsum(first) - 1
        self.at_words, self.at_pairs = np.split(at, 2)

    def counts(self) -> np.ndarray:
        """Of each distinct n-gram, how often training documents have it."""
        learned = np.repeat(~self.held, self.sizes)
        n = len(self.grams)
        return np.bincount(self.at_words[learned], minlength=n) + np.bincount(self.at_pairs[learned], minlength=n)


def _planes(values: np.ndarray) -> bytes:
    """First bytes, second bytes and so on of numbers: Spark's compression then takes out what is zero."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _block_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts, held in _by_block(batches):
            own = Block(texts, held)
            counts = own.counts()
            grams = own.grams
            del own
            out, held_bytes = [], 0
            for shard, a, b in _shards(grams, bits):
                out.append((shard, _planes(np.diff(grams[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype(np.uint32))))
                held_bytes += 12 * (b - a)
                if held_bytes > BATCH or b == len(grams):
                    yield pa.RecordBatch.from_pydict({"shard": [x[0] for x in out], "block": [block] * len(out), "grams": [x[1] for x in out], "counts": [x[2] for x in out]})
                    out, held_bytes = [], 0

    return rows


def _shards(grams: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    of = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, np.ndarray]]:
    """Blocks of rows in order of their block."""
    now, ids, texts, held = None, [], [], []
    for b in batches:
        for block, i, h, t in zip(b.column("block").to_pylist(), b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
            if block != now and texts:
                yield now, ids, texts, np.array(held)
                ids, texts, held = [], [], []
            now = block
            ids.append(i)
            texts.append(t)
            held.append(h)
    if texts:
        yield now, ids, texts, np.array(held)


def _total(rows: pa.Table) -> pa.Table:
    """Adds up a shard: totals for each block; types: how many training words the first block that has them names."""
    shard, block = rows.column("shard")[0].as_py(), rows.column("block").to_pylist()
    grams = [np.cumsum(_values(g.as_py(), np.uint64), dtype=np.uint64) for g in rows.column("grams")]
    counts = np.concatenate([_values(c.as_py(), np.uint32) for c in rows.column("counts")]).astype(np.int64)
    sizes = [len(g) for g in grams]
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    first = np.diff(every[order], prepend=~every[order[:1]]) != 0
    sums = np.add.reduceat(counts[order], np.flatnonzero(first))
    totals, new = np.empty(len(every), np.int64), np.zeros(len(every), bool)
    totals[order] = sums[np.cumsum(first) - 1]
    new[order] = first
    new &= (totals > 0) & (every & _ONE == 0)
    ends = np.cumsum(sizes)
    parts = [(e - n, e) for n, e in zip(sizes, ends, strict=True)]
    return pa.table({
        "block": pa.array(block, pa.int64()), "shard": pa.array([shard] * len(block), pa.int64()),
        "totals": pa.array([_planes(np.minimum(totals[a:b], 2**32 - 1).astype(np.uint32)) if totals[a:b].max() < 2**32 else _planes(totals[a:b].astype(np.uint64)) for a, b in parts], pa.binary()),
        "n": pa.array(sizes, pa.int64()), "types": pa.array([int(new[a:b].sum()) for a, b in parts], pa.int64()),
    })


def _meet(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A row per document of a block: its tokens' counts c(v), c(u v), and how often the document itself has them."""
    held = np.array(docs.column("held_out").to_pylist(), dtype=bool)
    own = Block(docs.column("text").to_pylist(), held)
    rows = sorted(zip(answers.column("shard").to_pylist(), answers.column("totals"), answers.column("n").to_pylist(), strict=True), key=lambda r: r[0])
    totals = np.concatenate([_values(t.as_py(), np.uint32 if len(t.as_py()) == 4 * n else np.uint64).astype(np.int64) for _, t, n in rows])
    words, both = totals[own.at_words], totals[own.at_pairs]
    out = []
    for k, (n, e) in enumerate(zip(own.sizes, own.ends, strict=True)):
        w, p = words[e - n : e], both[e - n : e]
        mine_w = mine_p = np.zeros(0, np.uint32)
        if not held[k]:
            mine_w, mine_p = _times(own.at_words[e - n : e]), _times(own.at_pairs[e - n : e])
        out.append((int(n), int((w > 0).sum()), float(np.log10(w + 1.0).sum()), *(_planes(x.astype(np.uint64 if len(x) and x.max() >= 2**32 else np.uint32)) for x in (w, p)), *(_planes(x.astype(np.uint32)) for x in (mine_w, mine_p))))
    types = sum(answers.column("types").to_pylist())
    columns = list(zip(*out, strict=True))
    return pa.table({
        "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()),
        "log_sum": pa.array(columns[2], pa.float64()), "words": pa.array(columns[3], pa.binary()), "pairs": pa.array(columns[4], pa.binary()),
        "own_words": pa.array(columns[5], pa.binary()), "own_pairs": pa.array(columns[6], pa.binary()), "types": pa.array([types] + [0] * (len(out) - 1), pa.int64()),
    })


MET = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, words binary, pairs binary, own_words binary, own_pairs binary, types long"


def _times(at: np.ndarray) -> np.ndarray:
    _, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
    return n[inverse].astype(np.uint32)


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """The table that scores and EM are computed from."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)) + F.count("*")).first()[0]
    n_blocks, bits = max(1, -(-int(size) // BLOCK)), max(0, int(size) // SHARD).bit_length()
    own = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), F.lit(n_blocks)).cast("long").alias("block"), F.col(id_col).cast("long").alias("doc_id"),
        (fold(F.col(id_col), folds) == held_fold).alias("held_out"), F.col(text_col).cast("binary").alias("text"),
    ).repartition(min(n_blocks, PARTITIONS), "block")
    sent = own.sortWithinPartitions("block").mapInArrow(_block_rows(bits), "shard long, block long, grams binary, counts binary")
    answers = sent.groupBy("shard").applyInArrow(_total, "block long, shard long, totals binary, n long, types long")
    return written(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_meet, MET), "token-counts")


def _document(words: bytes, both: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    w, p = (_values(x, np.uint32 if len(x) == 4 * n else np.uint64).astype(np.float64) for x in (words, both))
    return w, p


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the whole part of log2(c)."""
    return np.frexp(c)[1]


def held_out_counts(met: DataFrame, n_all: int, n_docs: int) -> np.ndarray:
    """Rows of bucket, tokens, mean p2, mean p1 (geometric; 0 where a cell's tokens have none), a document's own counts deleted."""

    def cell(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.minimum(NONE - 1, np.floor(-np.log10(np.where(p > 0, p, 1)) * CELLS)), NONE).astype(np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, logs = [np.empty(0, np.int64)], [np.empty((0, 2))]
            for words, both, mw, mp, n in zip(*(b.column(c).to_pylist() for c in ("words", "pairs", "own_words", "own_pairs", "n_tokens")), strict=True):
                w, p = _document(words, both, n)
                w, p = w - _values(mw, np.uint32), p - _values(mp, np.uint32)
                before = np.concatenate([[n_docs - 1.0], w[:-1]])
                p2, p1 = np.divide(p, before, out=np.zeros(n), where=before > 0), w / max(1, n_all - n)
                codes.append((bucket(before).astype(np.int64) << 20) | (cell(p2) << 10) | cell(p1))
                logs.append(np.log(np.where([p2 > 0, p1 > 0], [p2, p1], 1)).T)
            code, at, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            both = np.concatenate(logs)
            sums = [np.bincount(at, both[:, i], len(code)) for i in range(2)]
            yield pa.RecordBatch.from_pydict({"code": code, "n": count.astype(np.int64), "log2": sums[0], "log1": sums[1]})

    parts = met.where("not held_out").select("words", "pairs", "own_words", "own_pairs", "n_tokens").mapInArrow(rows, "code long, n long, log2 double, log1 double")
    got = parts.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "log2", "log1"))).toArrow()
    code, n, log2, log1 = (got.column(c).to_numpy() for c in ("code", "n", "log2", "log1"))
    order = np.argsort(code)
    code, n, log2, log1 = code[order], n[order].astype(float), log2[order], log1[order]
    return np.stack([code >> 20, n, np.where((code >> 10 & NONE) < NONE, np.exp(log2 / n), 0), np.where((code & NONE) < NONE, np.exp(log1 / n), 0)], axis=1)


def learn_weights(counts: np.ndarray, n_types: int, n_buckets: int = 66) -> np.ndarray:
    """Expectation-maximisation: a row of three weights (pair, word, uniform) for each bucket, from rows of bucket, tokens, p2, p1."""
    weights = np.tile([0.4, 0.59, 0.01], (n_buckets, 1))
    weights[0] = [0, 0.99, 0.01]
    if not len(counts):
        return np.tile([0.0, 0.0, 1.0], (n_buckets, 1))
    at, n = counts[:, 0].astype(np.int64), counts[:, 1]
    each = np.stack([counts[:, 2], counts[:, 3], np.full(len(n), 1 / (n_types + 1))], axis=1)
    for _ in range(STEPS):
        share = weights[at] * each
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(at, share[:, i], n_buckets) for i in range(3)], axis=1)
        sums += [0.5, 0.5, 0.5]  # a bucket with few tokens stays near even
        sums[0, 0] = 0
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    met = with_counts(docs, id_col, text_col, folds, held_fold)
    learned = F.when(~F.col("held_out"), F.col("n_tokens"))
    n_all, n_docs, n_types = (int(x or 0) for x in met.agg(F.sum(learned), F.count(learned), F.sum("types")).first())
    weights = learn_weights(held_out_counts(met, n_all, n_docs), n_types)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words, both, n in zip(*(b.column(c).to_pylist() for c in ("words", "pairs", "n_tokens")), strict=True):
                w, p = _document(words, both, n)
                before = np.concatenate([[float(n_docs)], w[:-1]])
                mixed = weights[bucket(before)]
                p2 = np.divide(p, before, out=np.zeros(n), where=before > 0)
                out.append(float(np.log10(mixed[:, 0] * p2 + mixed[:, 1] * w / max(1, n_all) + mixed[:, 2] / (n_types + 1)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(out, pa.float64())], names=[*kept, "score"])

    kept = ["doc_id", "held_out", "n_tokens", "n_known", "log_sum"]
    scored = met.select(*kept, "words", "pairs").mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double")
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(max(1, n_all + n_types + 1))))
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
