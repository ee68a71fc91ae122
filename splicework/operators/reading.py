"""What was said: expected against heard words, line layout, snippets, and which transcript belongs to what."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: So many words of one side may read as one of the other.
JOINED = 8
#: More pairs within tolerance than so many a word are not listed, but looked at one by one.
LISTED = 64
#: Times, and sums of a batch's times, stay below this as exact longs.
FAR = 2**60
WORD = ("pos", "letters", "start", "stop")
MATCH = ("expected", "n_expected", "heard", "n_heard")
#: From rows of texts to the expected and the heard words of some of them at once. Both have text, the number of a word's
#: text, which does not fall, keys, and WORD in order of pos.
Words = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]]


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def _types(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def aligned(expected: DataFrame, heard: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Matches in order: keys, expected, n_expected, heard, n_heard (pos of the first words, and how many).

    Words have pos, letters, start and stop, in order of pos and time. One word matches one, or up to JOINED words of the
    other side whose letters together are the same, if the middles of both are at most tolerance apart. Each expected word
    in turn takes the first heard word behind the last match that fits, one to one first. Words without letters match none.
    What matched decides what may match, so a key is folded in order; a word is held against those within tolerance alone."""
    out = f"{_types(expected, keys)}{', '.join(f'{c} long' for c in MATCH)}"

    def fold(own: pa.Table, other: pa.Table) -> pa.Table:
        found = [[]] * 4
        if own.num_rows and other.num_rows:  # a side that a key lacks has no columns either
            want, got = (d.sort_by("pos").append_column("text", pa.array(np.zeros(d.num_rows, np.int64))) for d in (own, other))
            want, got = _Side.of(want), _Side.of(got)
            i, n, k, m = _places(want, got, 2 * tolerance)
            found = want.pos[i], n, got.pos[k], m
        rows = (own if own.num_rows else other).select(keys).take(pa.array([0] * len(found[0]), pa.int64()))
        for name, values in zip(MATCH, found, strict=True):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    # every column anew: where both sides share some, Spark loses them as it prunes
    a, b = (d.select(*(F.col(c).alias(c) for c in keys), F.col("pos").cast("long").alias("pos"), *(F.col(c).alias(c) for c in WORD[1:])) for d in (expected, heard))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(fold, out)


def aligned_texts(texts: DataFrame, words: Words, keys: list[str], tolerance: int) -> DataFrame:
    """aligned, without a shuffle, where both sides come from the same rows: texts, one a key, and what makes words of them in a task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for expected, heard in words(batches):
            want, got = _Side.of(expected), _Side.of(heard)
            i, n, k, m = _places(want, got, 2 * tolerance)
            found = expected.select(keys).take(pa.array(i))
            yield pa.RecordBatch.from_pydict({c: found.column(c) for c in keys} | {c: pa.array(v, pa.int64()) for c, v in zip(MATCH, (want.pos[i], n, got.pos[k], m), strict=True)})

    return texts.mapInArrow(fold, f"{_types(texts, keys)}{', '.join(f'{c} long' for c in MATCH)}")


class _Side(NamedTuple):
    """Words of some texts: the number of each word's text, and WORD."""

    text: np.ndarray
    pos: np.ndarray
    letters: pa.Array
    start: np.ndarray
    stop: np.ndarray

    @classmethod
    def of(cls, words: pa.RecordBatch | pa.Table) -> _Side:
        values = {c: numbers(words[c]) for c in ("text", "pos", "start", "stop")}
        letters = words["letters"].combine_chunks() if isinstance(words, pa.Table) else words["letters"]
        return cls(letters=pc.fill_null(letters, ""), **values)


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _in_order(text: np.ndarray, values: np.ndarray) -> bool:
    return bool((np.diff(values) >= 0)[np.diff(text) == 0].all())


def _places(want: _Side, got: _Side, room: int) -> tuple[np.ndarray, ...]:
    """Matches of all texts at once: place of the first expected word, how many, place of the first heard word, how many.

    All pairs that could match are listed, which are those within tolerance; then each expected word in turn takes its first
    pair behind the last match. Where a word's pairs touch none of those before, that is its first pair, whatever came before;
    only the others are gone through one by one. Texts that cannot be listed so are matched word by word."""
    listed = _listed(want, got, room) if len(want.text) and len(got.text) else None
    if listed is None:
        return _one_by_one(want, got, room)
    i, n, k, m = listed
    if not len(i):
        return i, n, k, m
    first = np.flatnonzero(np.diff(i, prepend=-1))
    reach, reach_ = (np.maximum.accumulate(v)[first[1:] - 1] for v in (i + n, k + m))
    free = np.concatenate([[True], (reach <= i[first[1:]]) & (reach_ <= k[first[1:]])])
    alone = free & np.append(free[1:], True)  # no pair of another word touches this one's
    taken = np.zeros(len(i), bool)
    taken[first[alone]] = True
    others = np.flatnonzero(np.repeat(~alone, np.diff(first, append=len(i))))
    next_i = next_k = 0
    for c, i_, n_, k_, m_ in zip(others.tolist(), *(v[others].tolist() for v in (i, n, k, m)), strict=True):
        if i_ >= next_i and k_ >= next_k:
            taken[c], next_i, next_k = True, i_ + n_, k_ + m_
    return i[taken], n[taken], k[taken], m[taken]


def _one_by_one(want: _Side, got: _Side, room: int) -> tuple[np.ndarray, ...]:
    rows = []
    for text in np.intersect1d(want.text, got.text):
        (a, b), (c, d) = (np.searchsorted(s.text, [text, text + 1]) for s in (want, got))
        sides = [[range(x, y), *(v[x:y].tolist() for v in (s.start, s.stop))] for s, x, y in ((want, a, b), (got, c, d))]
        for s, x, y, side in ((want, a, b, sides[0]), (got, c, d, sides[1])):
            side.insert(1, s.letters.slice(x, y - x).to_pylist())
        rows += _matched(*sides, room)
    return tuple(np.array([r[c] for r in rows], np.int64) for c in range(4))


def apart(texts: int, room: int, *times: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
    """What to add to each text's times (numbers of texts, and times) so that one text lies behind another, more than room apart;
    None where sums of times would be too large."""
    low, high = np.full(texts, 2 * FAR), np.full(texts, -2 * FAR)
    for text, values in times:
        if len(values) and (values.min() <= -FAR or values.max() >= FAR):
            return None
        np.minimum.at(low, text, values)
        np.maximum.at(high, text, values)
    length = np.where(high < low, 0, high - np.minimum(low, high)) + room + 1
    if length.astype(float).sum() >= FAR:
        return None
    return np.cumsum(length) - length - np.where(high < low, 0, low)


def _listed(want: _Side, got: _Side, room: int) -> tuple[np.ndarray, ...] | None:
    """All pairs that could match, in the order in which they are tried; None where times are out of order or very large,
    or too many words lie within tolerance."""
    sides, texts = (want, got), 1 + int(max(want.text[-1], got.text[-1]))
    if not all(v.dtype.kind == "i" and _in_order(s.text, v) for s in sides for v in (s.start, s.stop)):
        return None
    move = apart(texts, room, *((s.text, v) for s in sides for v in (s.start, s.stop)))
    if move is None:
        return None
    begin, end = zip(*((s.start + move[s.text], s.stop + move[s.text]) for s in sides), strict=True)
    if any((np.diff(v) < 0).any() for v in (*begin, *end)):
        return None
    size = [numbers(pc.binary_length(s.letters)).astype(np.int64) for s in sides]
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in size]
    code = numbers(pa.concat_arrays([s.letters for s in sides]).dictionary_encode().indices)
    code = code[: len(want.text)], code[len(want.text) :]
    flat = [np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(s.text)], s.letters), "")[0].as_buffer(), np.uint8) for s in sides]
    most = LISTED * (len(want.text) + len(got.text)) + 10_000

    single = [np.flatnonzero(v) for v in size]  # words without letters match none
    middle = [(begin[s] + end[s])[single[s]] for s in (0, 1)]
    # the byte that stands first from each word on, and last before it
    head = [np.append(flat[s], 0).astype(np.int64)[sums[s][:-1]] * 31 for s in (0, 1)]
    tail = [np.append(flat[s], 0).astype(np.int64)[sums[s] - 1] * 7919 for s in (0, 1)]

    def look(side: int, words: int) -> np.ndarray:
        """A number below 2^16 of so many words' letters, the same for the same letters: from their length, first and last byte."""
        last = len(size[side]) - words + 1
        return ((sums[side][words:] - sums[side][:last]) * 524_287 + head[side][:last] + tail[side][words:]) & 0xFFFF

    known = np.zeros((2, 2**16), bool)
    for s in (0, 1):
        known[s][look(s, 1)[single[s]]] = True

    def near(one: int, many: int, words: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Words of a side, and first words of so many of the other, whose middles are near and that have equal letters."""
        last = len(size[many]) - words + 1
        if last <= 0 or not len(single[one]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if words == 1:
            y = single[many]
        else:
            y = np.flatnonzero(known[one][look(many, words)])
            y = y[sides[many].text[y] == sides[many].text[y + words - 1]]
        at = begin[many][y] + end[many][y + words - 1]
        a = np.searchsorted(middle[one], at - room, "left")
        count = np.searchsorted(middle[one], at + room, "right") - a
        total = int(count.sum())
        if total > most:
            return None
        x = single[one][np.arange(total) + np.repeat(a - np.cumsum(count) + count, count)]
        y = np.repeat(y, count)
        same = code[one][x] == code[many][y] if words == 1 else size[one][x] == sums[many][y + words] - sums[many][y]
        x, y = x[same], y[same]
        if words == 1:
            return x, y
        joined = pc.binary_join_element_wise(*(sides[many].letters.take(pa.array(y + j)) for j in range(words)), "")
        same = numbers(pc.equal(joined, sides[one].letters.take(pa.array(x))))
        return x[same], y[same]

    pairs = []
    for one, many, words in [(0, 1, 1), *((0, 1, w) for w in range(2, JOINED + 1)), *((1, 0, w) for w in range(2, JOINED + 1))]:
        found = near(one, many, words)
        if found is None:
            return None
        x, y = found
        ones, so_many = np.ones(len(x), np.int64), np.full(len(x), words)
        pairs.append((x, ones, y, so_many) if one == 0 else (y, so_many, x, ones))
    i, n, k, m = (np.concatenate(v) for v in zip(*pairs, strict=True))
    order = np.argsort(i << 32 | k, kind="stable")  # of one word and place, one to one stands first, then the shorter
    return i[order], n[order], k[order], m[order]


def _matched(want: list[list], got: list[list], room: int) -> list[tuple[int, int, int, int]]:
    """Matches of two lists of words, each as lists of WORD; twice their middles are at most room apart."""
    (pos, said, begin, end), (pos_, heard, begin_, end_) = want, got
    rows, i, low, behind, n_want, n_got = [], 0, 0, 0, len(pos), len(pos_)
    while i < n_want:
        text, at = said[i], begin[i] + end[i]
        latest = begin[i] + end[min(i + JOINED, n_want) - 1] + room
        while low < n_got and begin_[low] + end_[min(low + JOINED, n_got) - 1] < at - room:
            low += 1
        best = None
        for k in range(max(low, behind), n_got):
            word, middle = heard[k], begin_[k] + end_[k]
            if middle > latest:
                break
            if text:
                joined = ""
                for m in range(k, min(k + JOINED, n_got)):
                    joined += heard[m]
                    if not text.startswith(joined):
                        break
                    if joined == text and abs(begin_[k] + end_[m] - at) <= room:
                        best = 1, k, m + 1 - k
                        break
            if word and not best:
                joined = text
                for n in range(i + 1, min(i + JOINED, n_want)):
                    if not word.startswith(joined):
                        break
                    joined += said[n]
                    if joined == word and abs(middle - begin[i] - end[n]) <= room:
                        best = n + 1 - i, k, 1
                        break
            if best:
                break
        if best:
            n, k, m = best
            rows.append((pos[i], n, pos_[k], m))
            i, behind = i + n, k + m
        else:
            i += 1
    return rows


def differences(expected: DataFrame, heard: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Words of either side that no match has, grouped by the matched expected words before them: keys, after, start, stop, expected, heard."""

    def side(words: DataFrame, name: str, weight: Column) -> DataFrame:
        last = F.col(name) + F.col(f"n_{name}") - 1
        taken = matches.select(*keys, F.explode(F.sequence(F.col(name), last)).alias("pos"), last.alias("_last"), weight.alias("_n"))
        own = words.select(*keys, F.col("pos").cast("long").alias("pos"), "word", "start", "stop").join(taken, [*keys, "pos"], "left")
        done = F.sum(F.when(F.col("pos") == F.col("_last"), F.col("_n")).otherwise(0)).over(_by(keys, "pos").rowsBetween(W.Window.unboundedPreceding, 0))
        return own.withColumn("after", done).where("_last is null").select(*keys, "after", "start", "stop", F.struct("pos", "word").alias("w"), F.lit(name).alias("side"))

    both = side(expected, "expected", F.col("n_expected")).unionByName(side(heard, "heard", F.col("n_expected")))
    text = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("w")))), lambda w: w["word"]), " ")
    return both.groupBy(*keys, "after").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), text("expected").alias("expected"), text("heard").alias("heard"))


def differences_texts(texts: DataFrame, words: Words, keys: list[str], tolerance: int) -> DataFrame:
    """differences of what aligned_texts matches, without a shuffle; both sides have a word beside WORD."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for expected, heard in words(batches):
            want, got = _Side.of(expected), _Side.of(heard)
            i, n, k, m = _places(want, got, 2 * tolerance)
            before = np.zeros(int(max(want.text.max(initial=0), got.text.max(initial=0))) + 2, np.int64)  # matched words of the texts before
            np.add.at(before, want.text[i] + 1, n)
            before = np.cumsum(before)
            sides = []
            for s, first, count in ((want, i, n), (got, k, m)):
                edge, done = np.zeros((2, len(s.text) + 1), np.int64)
                edge[first] += 1
                edge[first + count] -= 1
                done[first + count - 1] = n
                free = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                # neither a text's number nor what was matched before falls, so their sum tells groups apart
                sides.append((s, free, np.cumsum(done)[free] + s.text[free]))
            groups, place = np.unique(np.concatenate([g for _, _, g in sides]), return_index=True)
            text = np.concatenate([s.text[free] for s, free, _ in sides])[place]
            key = pa.Table.from_batches([d.select(keys).take(pa.array(free)) for d, (_, free, _) in zip((expected, heard), sides, strict=True)]).take(pa.array(place))
            start, stop = np.full(len(groups), np.iinfo(np.int64).max), np.full(len(groups), np.iinfo(np.int64).min)
            found = {c: key[c].combine_chunks() for c in keys} | {"after": groups - text - before[text], "start": start, "stop": stop}
            for name, d, (s, free, g) in zip(("expected", "heard"), (expected, heard), sides, strict=True):
                at = np.searchsorted(groups, g)
                np.minimum.at(start, at, s.start[free])
                np.maximum.at(stop, at, s.stop[free])
                ends = np.append(np.searchsorted(g, groups), len(g)).astype(np.int32)
                found[name] = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), d["word"].take(pa.array(free))), " ")
            yield pa.RecordBatch.from_pydict({c: pa.array(v) if isinstance(v, np.ndarray) else v for c, v in found.items()})

    return texts.mapInArrow(fold, f"{_types(texts, keys)}after long, start long, stop long, expected string, heard string")


def match_summary_texts(texts: DataFrame, words: Words, keys: list[str], tolerance: int) -> DataFrame:
    """match_summary of what aligned_texts matches, without a shuffle."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for expected, heard in words(batches):
            want, got = _Side.of(expected), _Side.of(heard)
            i, n, _, m = _places(want, got, 2 * tolerance)
            first = np.flatnonzero(np.diff(want.text, prepend=-1))  # texts without expected words have no row
            place = np.searchsorted(want.text[first], want.text[i])
            sums = {"words": np.diff(first, append=len(want.text)), "matched": np.zeros(len(first), np.int64), "joined": np.zeros(len(first), np.int64)}
            np.add.at(sums["matched"], place, n)
            np.add.at(sums["joined"], place, (n + m > 2).astype(np.int64))
            found = expected.select(keys).take(pa.array(first))
            yield pa.RecordBatch.from_pydict({c: found.column(c) for c in keys} | {c: pa.array(v, pa.int64()) for c, v in sums.items()})

    own = texts.mapInArrow(fold, f"{_types(texts, keys)}words long, matched long, joined long")
    return own.withColumn("ratio", F.round(F.col("matched") / F.col("words"), 3))


def match_summary(expected: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words, matched, joined (matches of more than one word), ratio (to three places)."""
    found = matches.groupBy(*keys).agg(F.sum("n_expected").alias("matched"), F.count_if(F.col("n_expected") + F.col("n_heard") > 2).alias("joined"))
    own = expected.groupBy(*keys).agg(F.count("*").alias("words")).join(found, keys, "left")
    own = own.withColumns({"matched": F.coalesce("matched", F.lit(0)), "joined": F.coalesce("joined", F.lit(0))})
    return own.withColumn("ratio", F.round(F.col("matched") / F.col("words"), 3))


def balanced(words: list[str], width: int) -> str:
    """Words in as few lines of width as filling line by line gives (a longer word has its own); of those, the longest line
    is as short as can be, then the first line, then the second."""
    if not words:
        return ""
    ends, total = [0], 0
    for w in words:
        total += len(w) + 1
        ends.append(total)
    length = lambda i, j: ends[j] - ends[i] - 1
    fits = lambda i, j: j - i == 1 or length(i, j) <= width
    n, lines, start = len(words), 1, 0
    for j in range(1, n + 1):
        if not fits(start, j):
            lines, start = lines + 1, j - 1
    if lines == 1:
        return " ".join(words)
    if lines == 2:  # what cues mostly have
        _, j = min((max(length(0, j), length(j, n)), j) for j in range(1, n) if fits(0, j) and fits(j, n))
        return " ".join(words[:j]) + "\n" + " ".join(words[j:])
    # least[k][i]: how short the longest of k lines can be that hold the words from i on
    least = [[0 if i == n else float("inf") for i in range(n + 1)]]
    for _ in range(lines):
        before = least[-1]
        least.append([min((max(length(i, j), before[j]) for j in range(i + 1, n + 1) if fits(i, j)), default=float("inf")) for i in range(n + 1)])
    longest, i, out = least[lines][0], 0, []
    for left in range(lines - 1, -1, -1):
        j = next(j for j in range(i + 1, n + 1) if fits(i, j) and length(i, j) <= longest and least[left][j] <= longest)
        out.append(" ".join(words[i:j]))
        i = j
    return "\n".join(out)


def laid_out(text: Column, width: int) -> Column:
    """Cue texts (words with one space between) in balanced lines; a cue has few words. Null stays null."""

    @F.pandas_udf("string")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else balanced(t.split(), width))

    return lines(text)


def snippets(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The words of each key (pos, word, partial) as text: keys, count, text; partial words get a star, and more than limit
    (1 at least) words only show the first half and the last. A key has the words of one clip."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("word", F.when(F.col("partial"), "*").otherwise("")).alias("w")))), lambda x: x["w"])
    own = hits.groupBy(*keys).agg(said.alias("_w")).withColumn("count", F.size("_w"))
    head, tail = (limit + 1) // 2, limit // 2
    ends = F.concat(F.slice("_w", 1, head), F.array(F.lit("...")), F.slice("_w", -tail, tail) if tail else F.array().cast("array<string>"))
    text = F.when(F.col("count") <= limit, F.array_join("_w", " ")).otherwise(F.array_join(ends, " "))
    return own.select(*keys, F.col("count").cast("long").alias("count"), text.alias("text"))


def clock(time: Column) -> Column:
    """An exact time STRUCT<num, den> in seconds, to a millisecond, without zeros at the end; ~ where it was rounded."""
    num, den = time["num"].cast("decimal(20,0)") * 1000, time["den"].cast("decimal(20,0)")
    exact = num % den == 0
    half = num * 2 + den
    ms = F.when(exact, num / den).otherwise((half - half % (den * 2)) / (den * 2)).cast("decimal(30,0)").cast("long")
    rest = F.rtrim(F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("0"))
    seconds = ((ms - ms % 1000) / 1000).cast("long").cast("string")
    return F.concat(seconds, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.when(exact, "").otherwise("~"))


def bound(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """Which assets each transcript belongs to: document, asset (null: none). Both have id, path and sha256.

    An asset with a sha256 takes those of equal sha256; one without takes those of its path, slashes either way."""
    slashed = lambda c: F.translate(c, "\\", "/")
    d = documents.select(F.col("id").alias("document"), slashed("path").alias("_path"), F.col("sha256").alias("_sha"))
    by_content = d.join(assets.where("sha256 is not null").select(F.col("id").alias("asset"), F.col("sha256").alias("_sha")), "_sha").select("document", "asset")
    by_path = d.join(assets.where("sha256 is null").select(F.col("id").alias("asset"), slashed("path").alias("_path")), "_path").select("document", "asset")
    found = by_content.unionByName(by_path)
    return d.select("document").join(found, "document", "left")
