"""Edits of sequences, tracks, links and their attributes: a set of edits at once, each by key.

Edits are rows, so many tracks (or projects) are edited in one pass. What an edit of one key does not depend on the
order of other rows; where several edits of a key would clash, they are reported and none of that key is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators import intervals as iv
from splicework.operators.intervals import _by


def trimmed(rows: DataFrame, trims: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Sequential clips (keys, id, order, length, source_in) with new offsets and lengths of trims (keys, id, new_in, new_length); later clips follow."""
    own = rows.join(trims.select(*keys, "id", "new_in", "new_length"), [*keys, "id"], "left")
    own = own.withColumns({"source_in": F.coalesce("new_in", "source_in"), length: F.coalesce("new_length", length)}).drop("new_in", "new_length")
    return iv.placed(own, keys, order, length)


def removed(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those that ids (keys, id) names."""
    return rows.join(ids.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")


def appended(rows: DataFrame, more: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows and, behind each key's last, those of more in their own order; order is numbered anew from 1."""
    both = rows.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    return both.withColumn(order, F.row_number().over(_by(keys, "_late", order)).cast("long")).drop("_late")


def with_partners(ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids (clip) and the clips that share a link (link, clip) with one of them."""
    touched = links.join(ids.select("clip").distinct(), "clip", "left_semi").select("link").distinct()
    return ids.select("clip").unionByName(links.join(touched, "link", "left_semi").select("clip")).distinct()


def moved(clips: DataFrame, moves: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Clips after moves (keys, id, shift, target: the new last key, or null for the same), and the collisions (target keys, id, other_id).

    Moved clips replace what they meet in their new place. Where two moved clips of a key meet, the collision is
    reported, and nothing of that key is moved or replaced."""
    last = keys[-1]
    own = clips.join(moves.select(*keys, "id", "shift", F.col("target").alias("_target")), [*keys, "id"], "left")
    going = own.where("shift is not null").withColumns({"start": F.col("start") + F.col("shift"), "stop": F.col("stop") + F.col("shift"), "_old": F.col(last), last: F.coalesce("_target", last)}).drop("shift", "_target")
    clash = iv.collisions(going, keys, width)
    refused = clash.select(*keys).distinct()
    going_ok = going.join(refused, keys, "left_anti")
    back = going.join(refused, keys, "left_semi").select(*keys[:-1], F.col("_old").alias(last), "id").distinct()
    stay = own.where("shift is null").drop("shift", "_target")
    hit = iv.overlap_join(stay, going_ok.select(*keys, "start", "stop"), keys, width).select(*keys, "id").distinct()
    stay = removed(stay, hit, keys).unionByName(clips.join(back, [*keys, "id"], "left_semi"))
    return stay.unionByName(going_ok.drop("_old")), clash


def relinked(links: DataFrame, clips: DataFrame, drop: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (link, clip, start, source_in) without those of drop (link), and with the new ones of chosen (link, clip).

    A new link keeps where its clips stand when it is made. One that takes a part of an old link's members only, or a
    link number in use, is not made."""
    kept = links.join(drop.select("link").distinct(), "link", "left_anti")
    n_old = kept.groupBy("link").agg(F.count("*").alias("n"))
    part = chosen.select(F.col("link").alias("new"), "clip").join(kept.select("link", "clip"), "clip").groupBy("new", "link").agg(F.count("*").alias("m")).join(n_old, "link").where("m < n").select(F.col("new").alias("link"))
    bad = part.unionByName(kept.select("link")).distinct()
    new = chosen.join(bad, "link", "left_anti").join(clips.select(F.col("id").alias("clip"), "start", "source_in"), "clip")
    return kept.select("link", "clip", "start", "source_in").unionByName(new.select("link", "clip", "start", "source_in"))


def links_of_parts(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (link, clip) after clips were split into parts (clip, part from 0): link, part, clip, fits.

    Part n of each member makes the link's n-th part. Where members have unequal numbers of parts, fits is false."""
    n = parts.groupBy("clip").agg((F.max("part") + 1).alias("n"))
    own = links.join(n, "clip", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    every = own.groupBy("link").agg((F.min("n") == F.max("n")).alias("fits"))
    return own.join(every, "link").select("link", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "clip", "fits")


def faded_parts(pieces: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (keys, id, start, stop) of clips with the fades of the edges they share with their clip; inside: a cut lies inside a fade."""
    own = pieces.join(clips.select(*keys, "id", F.col("start").alias("_a"), F.col("stop").alias("_z"), "fade_in", "fade_out"), [*keys, "id"])
    some = (F.col("fade_in") > 0) | (F.col("fade_out") > 0)
    cut = lambda at: ((at - F.col("_a")) < F.col("fade_in")) | ((F.col("_z") - at) < F.col("fade_out"))
    head, tail = F.col("start") > F.col("_a"), F.col("stop") < F.col("_z")
    inside = some & ((head & cut(F.col("start"))) | (tail & cut(F.col("stop"))))
    return own.withColumns({"inside": inside, "fade_in": F.when(head, 0).otherwise(F.col("fade_in")), "fade_out": F.when(tail, 0).otherwise(F.col("fade_out"))}).drop("_a", "_z")


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the non-null values of changes (one row a key), and the rows of changes that are new; a true column _drop removes a row.

    For tracks' state, clips' attributes, sequences and assets alike."""
    values = [c for c in rows.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") if c in changes.columns else F.lit(None).cast(rows.schema[c].dataType).alias(f"_new_{c}") for c in values), (F.col("_drop") if "_drop" in changes.columns else F.lit(False)).alias("_drop"))
    both = rows.join(new, keys, "full_outer").where(~F.coalesce("_drop", F.lit(False)))
    return both.select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in values))


def lifted(clips: DataFrame, cuts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Clips with stretches taken out and all else left in place; part numbers a clip's pieces from 0 in order."""
    return iv.subtracted(clips, cuts, keys, width).withColumn("part", F.row_number().over(_by([*keys, "id"], "start")) - 1)


def range_of(clips: DataFrame, transitions: DataFrame, start: Column, stop: Column) -> tuple[DataFrame, DataFrame]:
    """What of clips lies in [start, stop), from 0; and the transitions (left_id, right_id) between clips that are wholly there."""
    own = iv.sliced(clips, start, stop)
    whole = clips.where((F.col("start") >= start) & (F.col("stop") <= stop)).select("id")
    kept = transitions.join(whole.select(F.col("id").alias("left_id")), "left_id", "left_semi").join(whole.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    return own.withColumns({"start": F.col("start") - start, "stop": F.col("stop") - start}), kept


def curve_issues(points: DataFrame, keys: list[str], low: int, high: int, most: int) -> DataFrame:
    """What is wrong with curves of keys (keys, index, num, den, value; duration is num / den too): keys, index, issue.

    count: none or more than most keys (index null); late: past the duration; coarse: a reduced denominator above 1,000,000;
    range: a value outside low..high; equal: the time of a key listed before, though written otherwise."""
    n = F.col("num").cast("decimal(38,0)")
    common = F.expr("aggregate(sequence(1, 64), struct(abs(num) as a, den as b), (s, i) -> if(s.b = 0, s, struct(s.b as a, s.a % s.b as b)), s -> s.a)")
    own = points.withColumn("_g", common)
    own = own.withColumns({"_n": F.expr("num div _g"), "_d": F.expr("den div _g")})
    first = F.row_number().over(_by([*keys, "_n", "_d"], "index"))
    late = n * F.col("end_den") > F.col("end_num").cast("decimal(38,0)") * F.col("den")
    own = own.withColumns({"_late": late, "_coarse": F.col("_d") > 1_000_000, "_range": ~F.col("value").between(low, high), "_equal": first > 1})
    kinds = F.array(*(F.when(F.col(f"_{k}"), F.lit(k)) for k in ("late", "coarse", "range", "equal")))
    each = own.select(*keys, "index", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("issue"))
    return each.unionByName(points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys, F.lit(None).cast("long").alias("index"), F.lit("count").alias("issue")))


def page(rows: DataFrame, keys: list[str], order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of each key in order, with total and next_offset (null on the last page)."""
    own = rows.withColumns({"_n": F.row_number().over(_by(keys, *order)), "total": F.count("*").over(W.Window.partitionBy(*keys))})
    end = offset + limit
    return own.where((F.col("_n") > offset) & (F.col("_n") <= end)).withColumn("next_offset", F.when(F.col("total") > end, F.lit(end).cast("long"))).drop("_n")


def listed(rows: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """The first `most` values of each key in order, and the exact count: keys, listed, count. No key's values are gathered whole."""
    first = rows.withColumn("_n", F.row_number().over(_by(keys, *order))).where(F.col("_n") <= most)
    some = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias("listed"))
    return some.join(rows.groupBy(*keys).agg(F.count("*").alias("count")), keys)


def shortened(rows: DataFrame, keep: list[str], arrays: list[str], most: int) -> DataFrame:
    """Rows with each array cut to its first `most` values beside its full size, and the names of those that were cut."""
    cut = F.filter(F.array(*(F.when(F.size(a) > most, F.lit(a)) for a in arrays)), lambda x: x.isNotNull())
    return rows.select(*keep, *(F.slice(a, 1, most).alias(a) for a in arrays), *(F.size(a).alias(f"n_{a}") for a in arrays), cut.alias("shortened"))


def portable(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Rows whose path is absolute and below root, with the path from there on; others that are absolute have null."""
    own = F.regexp_replace(F.col(path), r"\\", "/")
    inside = own.startswith(root.rstrip("/") + "/")
    rooted = own.startswith("/") | own.rlike("^[A-Za-z]:/")
    return rows.where(rooted).withColumn("portable", F.when(inside, F.substring(own, len(root.rstrip("/")) + 2, 10_000)))


def snapshots_at(revisions: DataFrame, asked: DataFrame, key: str = "project") -> DataFrame:
    """The snapshot of each asked (key, revision; null: the head): key, revision, snapshot, state (ok, missing, damaged).

    damaged: the snapshot's SHA-256 is not its snapshot_hash; such a snapshot is not given out."""
    heads = revisions.groupBy(key).agg(F.max("revision").alias("_head"))
    want = asked.select(key, F.col("revision").alias("_asked")).join(heads, key, "left").withColumn("revision", F.coalesce("_asked", "_head"))
    own = want.join(revisions.select(key, "revision", "snapshot", "snapshot_hash"), [key, "revision"], "left")
    good = F.sha2(F.col("snapshot"), 256) == F.col("snapshot_hash")
    state = F.when(F.col("snapshot").isNull(), "missing").when(good, "ok").otherwise("damaged")
    return own.select(key, "revision", F.when(good, F.col("snapshot")).alias("snapshot"), state.alias("state"))


def listing(files: DataFrame, folder: str, extensions: list[str], hidden: str, limit: int, recursive: bool = True) -> DataFrame:
    """Files (path, length) below folder with one of the extensions (any case; none: all): path, bytes, total, truncated; the first limit by path.

    Whatever lies in a folder whose name is hidden, or begins with hidden and a dash, is left out."""
    base = folder.rstrip("/") + "/"
    own = files.where(F.col("path").startswith(base)).select(F.substring("path", len(base) + 1, 10_000).alias("path"), F.col("length").alias("bytes"))
    names = F.split("path", "/")
    own = own.where(~F.exists(names, lambda n: (n == hidden) | n.startswith(f"{hidden}-")))
    if not recursive:
        own = own.where(~F.col("path").contains("/"))
    if extensions:
        own = own.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin([e.lstrip(".").lower() for e in extensions]))
    first = own.orderBy("path").limit(limit)
    total = own.groupBy(F.lit(1).alias("_one")).agg(F.count("*").alias("total"))  # one row
    return first.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one").withColumn("truncated", F.col("total") > limit)
