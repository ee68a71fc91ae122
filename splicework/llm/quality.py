"""Quality classifier: Bradley-Terry ranking of documents, thresholded at a score quantile.

Features are counts and shares of a whole text. The model is linear: a document's strength is w * features,
and of a pair (label 1, label 0) the first is preferred with probability sigmoid(difference of strengths);
w minimises the logistic loss over all pairs of labelled rows plus a ridge. The threshold is the quantile of
the training strengths at the share of label 0, halfway to the next; a score is
sigmoid(strength - threshold + logit(CUT)), so that score >= CUT is what the quantile accepts.

The fit reads every labelled row. Each Newton step is two passes over their features: sums by label and bin of strength
(1 / BINS wide), which stand for all pairs of a row of one label with one of the other, and second moments. Bins put the
gradient off by some 1e-5. Sums come to the driver, a row a bin; no labelled row does but those beside the threshold,
`most` at once.

Null and empty texts have all counts 0 and are scored like any other. Null ids are in no fold and are never
learned from; null labels neither. Without both labels all scores are 0.5. Repeated rows get a row each, and count each
in the fit. Equal strengths get equal scores; where they tie at the quantile, the threshold stands at them. Empty
tables give no rows; other columns, of any name but quality_score, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicework.llm.common import fold, written

PAIRS, RIDGE, CUT = 200_000, 1e-3, 0.3
#: Bins of a unit of strength, the largest strength that has a bin of its own, and strengths that come to the driver at once.
BINS, FARTHEST, MOST = 32, 32, 20_000


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.norm(x) @ self.weights - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(text: bytes) -> list[float]:
    codes = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, words = max(1, len(text)), text.split()
    n_words, lower = max(1, len(words)), [w.lower() for w in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    letters = max(1, int(codes[65:91].sum() + codes[97:123].sum()))
    pairs = list(zip(lower, lower[1:], strict=False))
    n_pairs = max(1, len(pairs))
    return [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sum(map(len, words)) / n_words,
        np.log1p(max(map(len, words), default=0)),
        codes[65:91].sum() / letters,
        codes[48:58].sum() / n,
        sum(int(codes[ord(c)]) for c in "#*$%&@^~=_\\") / n,
        sum(int(codes[ord(c)]) for c in "|<>[]{}/") / n,
        sum(int(codes[ord(c)]) for c in "!?") / n,
        sum(int(codes[ord(c)]) for c in ".,;:") / n,
        codes[128:].sum() / n,
        len(set(lower)) / n_words,
        len(set(pairs)) / n_pairs,
        sum(a == b for a, b in pairs) / n_pairs,
        len(set(lines)) / n_lines,
        sum(x.rstrip()[-1:] in b".!?\"')" for x in lines) / n_lines,
        sum(len(w) == 1 for w in words) / n_words,
        np.log1p(n / n_lines),
    ]


N_FEATURES = len(features(b""))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py() or b"") for t in b.column("text")]
        yield pa.RecordBatch.from_pydict({"id": b.column("id"), "x": pa.array(rows, pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, most: int = MOST) -> Model:
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.where((fold(F.col("id"), folds) > 0) & F.col("label").isNotNull())
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    # features are narrow: they are dealt out by id, and texts are not
    rows = own.mapInArrow(_featured, f"id {own.schema['id'].dataType.simpleString()}, x array<double>")
    return fitted(written(rows.join(chosen, "id").select("label", "x"), "quality-features"), most)


def fitted(rows: DataFrame, most: int = MOST) -> Model:
    """The model of rows label, x."""
    each = [F.col("x")[i] for i in range(N_FEATURES)]
    got = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), F.array(*map(F.avg, each)), F.array(*map(F.stddev_pop, each))).first()
    n_good, n_bad = got[0], got[1]
    if not n_good or not n_bad:
        return _undecided()
    # rounded, as sums of a rerun differ in their last bits
    mean, scale = np.round(got[2], 12), np.round(np.array(got[3]) + 1e-9, 12)
    model = Model(mean, scale, np.zeros(N_FEATURES), 0.0)
    for _ in range(30):  # Newton steps on the logistic loss of all pairs
        step = _newton_step(rows, model, n_good, n_bad)
        model = replace(model, weights=model.weights - step)
        if np.abs(step).max() < 1e-5:
            break
    model = replace(model, weights=np.round(model.weights, 9))
    strengths = written(rows.mapInArrow(_strengths(model), "s double"), "quality-strengths")
    return replace(model, threshold=(_ranked(strengths, n_bad - 1, most) + _ranked(strengths, n_bad, most)) / 2)


def _summed(rows: DataFrame, sums, size: int) -> dict[int, np.ndarray]:
    """By key, the sums of the vectors that sums(x, label) gives: keys, and a row of a matrix for each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
            key, v = sums(x, b.column("label").to_numpy())
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "v": pa.FixedSizeListArray.from_arrays(v.reshape(-1), size).cast(pa.list_(pa.float64()))})

    got = rows.mapInArrow(partial, "key long, v array<double>").groupBy("key").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(size))).alias("v"))
    return {r["key"]: np.array(r["v"]) for r in got.collect()}


def _newton_step(rows: DataFrame, model: Model, n_good: int, n_bad: int) -> np.ndarray:
    def binned(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (label == 0) | (label == 1)
        z = model.norm(x[keep])
        s = z @ model.weights
        at = np.clip(np.floor(s * BINS), -FARTHEST * BINS, FARTHEST * BINS - 1).astype(np.int64) + FARTHEST * BINS
        key, place = np.unique(label[keep].astype(np.int64) * 2 * FARTHEST * BINS + at, return_inverse=True)
        v = np.zeros((len(key), N_FEATURES + 2))
        np.add.at(v, place, np.column_stack([np.ones(len(s)), s, z]))
        return key, v

    sums = sorted(_summed(rows, binned, N_FEATURES + 2).items())
    bad, good = (np.array([v for k, v in sums if k // (2 * FARTHEST * BINS) == label]) for label in (0, 1))
    s_bad, s_good = bad[:, 1] / bad[:, 0], good[:, 1] / good[:, 0]
    p = 1 / (1 + np.exp(np.clip(s_good[:, None] - s_bad, -30, 30)))  # of a row of each bin: how far its pair is from being preferred
    gradient = RIDGE * model.weights - ((p @ bad[:, 0]) @ good[:, 2:] - (good[:, 0] @ p) @ bad[:, 2:]) / (n_good * n_bad)
    q = p * (1 - p)
    cross = good[:, 2:].T @ q @ bad[:, 2:] / (n_good * n_bad)
    curve = {0: (s_bad, good[:, 0] @ q / (n_good * n_bad)), 1: (s_good, q @ bad[:, 0] / (n_good * n_bad))}

    def moments(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = model.norm(x)
        s = z @ model.weights
        weight = sum(np.where(label == c, np.interp(s, *curve[c]), 0.0) for c in (0, 1))
        return np.arange(N_FEATURES), (z * weight[:, None]).T @ z

    second = _summed(rows, moments, N_FEATURES)
    hessian = np.array([second[i] for i in range(N_FEATURES)]) - cross - cross.T + RIDGE * np.eye(N_FEATURES)
    return np.linalg.solve(hessian, gradient)


def _strengths(model: Model):
    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_pydict({"s": pa.array(model.norm(x) @ model.weights)})

    return strengths


def _ranked(strengths: DataFrame, rank: int, most: int) -> float:
    """The strength of a rank from 0: the range that holds it is cut into bins until one with `most` rows at most is left."""
    n, low, high = strengths.agg(F.count("*"), F.min("s"), F.max("s")).first()
    while n > most and low < high:
        at = F.least(F.floor((F.col("s") - low) / (high - low) * 1000), F.lit(999))
        bins = strengths.where(F.col("s").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for _, n, low, high in sorted(bins.collect()):
            if rank < n:
                break
            rank -= n
    if low == high:
        return low
    return strengths.where(F.col("s").between(low, high)).orderBy("s").toArrow().column("s")[rank].as_py()


def _undecided() -> Model:
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(np.log(CUT / (1 - CUT))))


def bradley_terry(x: np.ndarray, y: np.ndarray) -> Model:
    """The same on arrays, over PAIRS drawn pairs: fit() does not use it, tests hold it beside fitted()."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return _undecided()
    mean, scale = x.mean(0), x.std(0) + 1e-9
    rng = np.random.default_rng(5)
    norm = lambda v: np.clip((v - mean) / scale, -8, 8)
    d = norm(good)[rng.integers(0, len(good), PAIRS)] - norm(bad)[rng.integers(0, len(bad), PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = RIDGE * w - d.T @ p / PAIRS
        hessian = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort(norm(x) @ w)
    k = len(bad)
    return Model(mean, scale, w, float((s[k - 1] + s[k]) / 2))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs and quality_score; all columns stay."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t or b"") for t in texts], dtype=float).reshape(-1, N_FEATURES)))

    return docs.withColumn("quality_score", score(F.col(text_col).cast("binary")))
