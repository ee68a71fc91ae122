"""Transcripts: words as intervals of a source, in order; sounds between them, cuts, seams and captions.

Words have columns pos, word, start and stop beside their keys; within a key they do not overlap.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators import intervals as iv

EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z"


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def normalized(text: Column, kept: str = "") -> Column:
    """Letters and digits only, in lower case, and what is kept beside them."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{kept}]", "")


def filler_like(text: Column) -> Column:
    """Whether letters read like a hesitation: um, uh, er, hmm and their like, of four letters at most."""
    return F.upper(text).rlike(r"^(?=.{1,4}\z)(?:[AEU]+H?[MR]*|H?M+)\z")


def consecutive(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Runs of rows whose index rises by one: keys, first, last, length."""
    own = rows.select(*keys, index).distinct()
    own = own.withColumn("_g", F.col(index) - F.row_number().over(_by(keys, index)))
    return own.groupBy(*keys, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).drop("_g")


def around(sounds: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """sounds (keys, start, stop, ...) with the pos of the last word that ends by their middle and of the first
    that starts after it, and whether a word covers the middle. Three as-of passes; middles are doubled, so exact."""
    middle = F.col("start") + F.col("stop")
    past = words.select(*keys, (F.col("stop") * 2).alias("at"), F.col("pos").alias("after"))
    own = iv.as_of(sounds.withColumn("at", middle), past, keys, "after")
    held = words.select(*keys, (F.col("start") * 2).alias("at"), (F.col("stop") * 2).alias("_until"))
    own = iv.as_of(own, held, keys, "_until")
    to_come = words.select(*keys, (F.col("start") * -2 + 1).alias("at"), F.col("pos").alias("before"))
    own = iv.as_of(own.withColumn("at", -F.col("at")), to_come, keys, "before")
    return own.withColumn("covered", F.coalesce(F.col("_until") > -F.col("at"), F.lit(False))).drop("at", "_until")


def after_cuts(words: DataFrame, cuts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """What cuts leave of each word: keys, pos, kept (ticks), fate (whole, partial, removed)."""
    own = words.select(*keys, "pos", "start", "stop")
    gone = iv.overlap_join(own, iv.merged(cuts, keys).drop("members"), keys, width)
    gone = gone.groupBy(*keys, "pos").agg(F.sum(F.least("stop", "other_stop") - F.greatest("start", "other_start")).alias("_gone"))
    kept = F.col("stop") - F.col("start") - F.coalesce("_gone", F.lit(0))
    fate = F.when(F.col("_gone").isNull(), "whole").when(kept > 0, "partial").otherwise("removed")
    return own.join(gone, [*keys, "pos"], "left").select(*keys, "pos", kept.alias("kept"), fate.alias("fate"))


def assembled(selections: DataFrame, words: DataFrame, keys: list[str], order: str, frame: int) -> DataFrame:
    """A paper edit: selections (keys, order, first, last: pos of words) as clips of whole frames, placed one behind another.

    Selections that name a missing word are left out."""
    a = words.select(*keys, F.col("pos").alias("first"), (F.floor(F.col("start") / frame) * frame).alias("source_in"))
    b = words.select(*keys, F.col("pos").alias("last"), (F.ceil(F.col("stop") / frame) * frame).alias("_end"))
    own = selections.join(a, [*keys, "first"]).join(b, [*keys, "last"]).withColumn("_n", F.col("_end") - F.col("source_in"))
    return iv.placed(own, keys, order, "_n").drop("_n", "_end")


def seams(windows: DataFrame, keys: list[str]) -> DataFrame:
    """windows (keys, start, stop, in order of start) with from_ and to_: neighbours that overlap are parted in the
    middle of what they share, rounded down; others keep their own ends."""
    w = _by(keys, "start")
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    begin = F.when(F.lag("stop").over(w) > F.col("start"), half(F.lag("stop").over(w), F.col("start"))).otherwise(F.col("start"))
    end = F.when(F.lead("start").over(w) < F.col("stop"), half(F.lead("start").over(w), F.col("stop"))).otherwise(F.col("stop"))
    return windows.withColumns({"from_": begin, "to_": end})


def heard_once(words: DataFrame, windows: DataFrame, keys: list[str], window: str) -> DataFrame:
    """Words (keys, window, start, stop, ...) of overlapping windows, each kept by the window whose part has its middle."""
    own = words.join(seams(windows, keys).select(*keys, window, "from_", "to_"), [*keys, window])
    middle = F.col("start") + F.col("stop")
    return own.where((middle >= F.col("from_") * 2) & (middle < F.col("to_") * 2)).drop("from_", "to_")


def heard_once_evenly(words: DataFrame, step: int, length: int, window: str) -> DataFrame:
    """heard_once over even windows, without a join: words (start, stop, after, ...) with the number of the window that keeps each.

    Window k, from 0 on, begins at k * step and has length ticks; a word is in those that hold its start, and a window without
    words is none. after is the start of the key's next word, null behind the last. The seam before the last window that holds a
    word concerns only words of the window before as well, and the seam behind it only words that reach so far: then a window
    behind has the next word, if any. So a word is placed by its own row."""
    if not 0 < step <= length <= 2 * step:
        raise ValueError(f"windows of {length} ticks, {step} apart, leave gaps or overlap others than their neighbours")
    start, half = F.col("start"), (length - step) // 2
    into = start % step  # the last window that holds the word begins so far before it
    middle = into * 2 + F.col("stop") - start
    alone = F.coalesce(F.col("after") - start + into >= step + length, F.lit(True))
    kept = (start >= 0) & ((middle < (step + half) * 2) | (middle < length * 2) & alone)
    before = (start >= step) & (middle < half * 2)
    return words.where(kept).withColumn(window, F.expr(f"start div {step}") - before.cast("long"))


def names(words: DataFrame, keys: list[str]) -> DataFrame:
    """Terms that look like names, and where they first stand: keys, term, pos.

    A name has a capital behind its first letter and a small one, or a capital first letter away from the start of
    a sentence; I and its contractions are none."""
    core = F.regexp_replace("word", EDGES, "")
    starts = F.coalesce(F.lag(F.substring("word", -1, 1).isin(".", "!", "?", ":")).over(_by(keys, "pos")), F.lit(True))
    own = words.select(*keys, "pos", core.alias("term"), starts.alias("_starts"))
    term = F.col("term")
    inner = term.rlike(r"(?s)^.+\p{Lu}") & term.rlike(r"\p{Ll}")
    capital = term.rlike(r"^\p{Lu}") & ~F.col("_starts") & (term != "I") & ~term.startswith("I'")
    return own.where(inner | capital).groupBy(*keys, "term").agg(F.min("pos").alias("pos"))


def cues(words: DataFrame, keys: list[str], pause: int, longest: int, line_chars: int, lines: int) -> DataFrame:
    """Words grouped into caption cues: keys, cue, first, last (pos), start, stop, text.

    A word joins the cue before it unless a pause or a sentence's end lies between, or the cue would last longer than
    `longest` or need more than `lines` lines. What was joined decides what may join, so each key is folded in order."""
    shape = words.select(*keys, "pos", "word", "start", "stop")
    out = f"{', '.join(f'{k} {shape.schema[k].dataType.simpleString()}' for k in keys)}, cue long, first long, last long, start long, stop long, text string"

    def fold(said: pa.Table) -> pa.Table:
        made, row, width = [], 0, 0
        for pos, word, start, stop in zip(*(said.sort_by("pos")[c].to_numpy().tolist() for c in ("pos", "word", "start", "stop")), strict=True):
            n = len(word)
            fits = width + 1 + n <= line_chars
            if made:
                c = made[-1]
                open_ = start - c["stop"] < pause and c["text"][-1].rstrip().rstrip("\"'”’)]»")[-1:] not in (".", "!", "?", "…")
                if open_ and stop - c["start"] <= longest and (fits or row < lines):
                    row, width = (row, width + 1 + n) if fits else (row + 1, n)
                    c["text"].append(word)
                    c["last"], c["stop"] = pos, stop
                    continue
            row, width = 1, n
            made.append({"cue": len(made), "first": pos, "last": pos, "start": start, "stop": stop, "text": [word]})
        found = said.select(keys).take(pa.array([0] * len(made), pa.int64()))
        for name in ("cue", "first", "last", "start", "stop"):
            found = found.append_column(name, pa.array([c[name] for c in made], pa.int64()))
        return found.append_column("text", pa.array([" ".join(c["text"]) for c in made], pa.string()))

    return shape.groupBy(*keys).applyInArrow(fold, out)


def stitched(windows: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Which words of overlapping windows stay: keys, window, pos.

    windows have window, start and stop, in order of start; words have window, pos, start and stop. Where two neighbours
    overlap, the earlier keeps the words whose middle is before the middle of what they share; the later those that begin at
    the seam or behind it: that middle, or the end of the last word kept, whichever is later. A window's words are thinned by
    its earlier neighbour first, so a key is folded in order."""
    out = f"{', '.join(f'{k} {words.schema[k].dataType.simpleString()}' for k in keys)}, window long, pos long"

    def fold(spans: pa.Table, said: pa.Table) -> pa.Table:
        rows = _stitched(spans, said) if spans.num_rows and said.num_rows else []  # a side that a key lacks has no columns either
        found = (spans if spans.num_rows else said).select(keys).take(pa.array([0] * len(rows), pa.int64()))
        return found.append_column("window", pa.array([r[0] for r in rows], pa.int64())).append_column("pos", pa.array([r[1] for r in rows], pa.int64()))

    a = windows.select(*keys, F.col("window").cast("long").alias("window"), "start", "stop")
    b = words.select(*(F.col(c).alias(c) for c in keys), F.col("window").cast("long").alias("window"), F.col("pos").cast("long").alias("pos"), *(F.col(c).alias(c) for c in ("start", "stop")))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(fold, out)


def _stitched(spans: pa.Table, said: pa.Table) -> list[tuple[int, int]]:
    """window and pos of the words of one key that stay."""
    own: dict[int, list[tuple[int, int, int]]] = {}
    for window, *word in zip(*(said.sort_by("pos")[c].to_numpy().tolist() for c in ("window", "pos", "start", "stop")), strict=True):
        own.setdefault(window, []).append(tuple(word))
    kept, left, left_stop = [], None, None
    for window, start, stop in zip(*(spans.sort_by("start")[c].to_numpy().tolist() for c in ("window", "start", "stop")), strict=True):
        right = own.get(window, [])
        if left is not None and start < left_stop:
            middle = (start + left_stop) // 2
            kept[-1][1] = left = [w for w in left if w[1] + w[2] < 2 * middle]
            seam = max(middle, left[-1][2]) if left else middle
            right = [w for w in right if w[1] >= seam]
        kept.append([window, right])
        left, left_stop = right, stop
    return [(window, w[0]) for window, part in kept for w in part]
