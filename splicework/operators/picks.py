"""Neighbours, ordered events, separated peaks, findings, references and look-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators.intervals import _by


def adjacent(clips: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of clips of which one begins where the other ends: keys, left_id, right_id, at. An equality join on key and time."""
    left = clips.select(*keys, F.col("id").alias("left_id"), F.col("stop").alias("at"))
    return left.join(clips.select(*keys, F.col("id").alias("right_id"), F.col("start").alias("at")), [*keys, "at"])


def events(clips: DataFrame, keys: list[str]) -> DataFrame:
    """Ends and starts of clips in order, ends first at one time, then by id: keys, place (from 1), at, kind, id."""
    each = F.array(F.struct(F.col("stop").alias("at"), F.lit(0).alias("rank"), F.lit("end").alias("kind")), F.struct(F.col("start").alias("at"), F.lit(1).alias("rank"), F.lit("start").alias("kind")))
    own = clips.select(*keys, "id", F.explode(each).alias("e")).select(*keys, "id", "e.*")
    return own.withColumn("place", F.row_number().over(_by(keys, "at", "rank", "id"))).drop("rank")


def peaks(scores: DataFrame, keys: list[str], at: str, score: str, most: int, apart: int) -> DataFrame:
    """Up to `most` places of each key, the greatest score first (the least place on ties), all `apart` or more from one another: keys, at, score, pick.

    A pick keeps 2 * apart - 2 other places from being one, so the first most * (2 * apart - 1) by score hold all picks: a
    fixed number of rows of a key comes to one task, whatever the key has."""
    rank = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(at)))
    own = scores.select(*keys, at, score).withColumn("pick", rank.cast("long")).where(F.col("pick") <= most * (2 * apart - 1))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = pdf.sort_values("pick")
        for i, place in enumerate(rows[at].tolist()):
            if len(kept) < most and all(abs(place - rows[at].iloc[j]) >= apart for j in kept):
                kept.append(i)
        return rows.iloc[kept].assign(pick=range(1, len(kept) + 1))

    return own.groupBy(*keys).applyInPandas(fold, own.schema)


def findings(parts: dict[str, tuple[DataFrame, str, Column]], severity: dict[str, str]) -> DataFrame:
    """A row per finding: issue, subject, n, severity. parts name, for each issue, its rows, the column of their subject, and a number."""
    out = None
    for issue, (rows, subject, n) in parts.items():
        own = rows.select(F.lit(issue).alias("issue"), F.col(subject).cast("long").alias("subject"), n.cast("long").alias("n"), F.lit(severity.get(issue, "warning")).alias("severity"))
        out = own if out is None else out.unionByName(own)
    return out


def caption_losses(cues: DataFrame, keep: list[str], lost: dict[str, Column]) -> DataFrame:
    """What a caption format cannot hold: a row per cue and feature that holds for it: keep, loss."""
    kinds = F.array(*(F.when(holds, F.lit(name)) for name, holds in lost.items()))
    return cues.select(*keep, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("loss"))


def resolved(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (file, select: a name, or null) with the file's JSON document, or what select names in it: value; null where there is none.

    files: path, content. Each file is joined once however many requests name it."""
    own = requests.join(files.withColumnsRenamed({"path": "file"}), "file", "left")
    part = F.call_function("get_json_object", F.col("content"), F.concat(F.lit("$."), F.col("select")))
    return own.withColumn("value", F.when(F.col("select").isNull(), F.col("content")).otherwise(part)).drop("content")


def looked_up(rows: DataFrame, registry: DataFrame, code: str) -> DataFrame:
    """Rows with the registry's columns for their code; unknown codes have those of the code "UNKNOWN"."""
    names = [c for c in registry.columns if c != code]
    known = registry.select(code, *(F.col(c).alias(f"_{c}") for c in names))
    other = registry.where(F.col(code) == "UNKNOWN").select(F.lit(1).alias("_one"), *(F.col(c).alias(f"_other_{c}") for c in names))
    own = rows.join(known, code, "left").withColumn("_one", F.lit(1)).join(other, "_one", "left")
    return own.select(*rows.columns, *(F.when(F.col(f"_{names[0]}").isNull(), F.col(f"_other_{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in names))


def frame_index(packets: DataFrame, keys: list[str]) -> DataFrame:
    """packets (keys, id, pts, key_frame, samples) in order of pts, then id: frame (from 0), pts, length (null for the last), anchor
    (the last key frame at or before it, null before the first), samples_before."""
    w = _by(keys, "pts", "id")
    own = packets.withColumns({"frame": F.row_number().over(w) - 1, "length": F.lead("pts").over(w) - F.col("pts")})
    run = w.rowsBetween(W.Window.unboundedPreceding, 0)
    own = own.withColumn("anchor", F.max(F.when(F.col("key_frame"), F.col("frame"))).over(run))
    return own.withColumn("samples_before", F.sum("samples").over(run) - F.col("samples")).select(*keys, "id", "frame", "pts", "length", "anchor", "samples_before")
