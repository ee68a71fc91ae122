"""Checks: histories, snapshots, transcripts and media against their rules. Each gives a row per violation.

Null counts as absent; a rule about an absent value does not fire unless it says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _by(keys: list[str], *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def _fired(rows: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """keep and issue, for each rule that holds in a row."""
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(found).alias("issue"))


def undo_pointers(actions: DataFrame, project: str) -> DataFrame:
    """actions (project, revision from 0, action) with restored_from and undo_target.

    create has neither; apply and restore can be undone to the revision before; undo restores what the revision before it
    can be undone to, and can then be undone to what that one could. Where there is nothing to undo, it points nowhere.
    restore keeps its own restored_from. What undo meets depends on all before, so a project is folded in order,
    many projects in one pass of a task."""
    shape = actions.select(project, F.col("revision").cast("long").alias("revision"), "action", F.col("restored_from").cast("long").alias("restored_from"), F.lit(None).cast("long").alias("undo_target"))

    ordered = shape.repartition(project).sortWithinPartitions(project, F.col("revision").asc_nulls_last())
    return ordered.mapInArrow(_undo_rows, shape.schema)


def _undo_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of project, revision, action, restored_from, undo_target, a project's behind one another, the last two filled in."""
    now, back = None, None
    for batch in batches:
        restored, undo = [], []
        for project, action, own in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if back is None or project != now:
                now, back = project, []
            i = len(back)
            to = back[i - 1] if action == "undo" and i else None
            restored.append(to if action == "undo" else own)
            back.append((None if to is None else back[to]) if action == "undo" else i - 1 if i else None)
            undo.append(back[i])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(restored, pa.int64()), pa.array(undo, pa.int64())], names=batch.schema.names)


def history(revisions: DataFrame, project: str) -> DataFrame:
    """What is wrong with revisions: project, revision, issue.

    Columns: revision, parent, action, undo_target, restored_from, snapshot, snapshot_hash. Issues: gap (revisions do not
    run from 0 by one), checksum, action (unknown, or not at its place), parent, undo (its pointer), restored (absent, or
    not before), content (differs from what it restores). Repeated rows of a revision are gaps."""
    w = _by([project], "revision")
    own = revisions.withColumns({"_at": F.row_number().over(w) - 1, "_before": F.lag("undo_target").over(w)})
    target = revisions.select(F.col(project).alias("_p"), F.col("revision").alias("_r"), F.sha2("snapshot", 256).alias("_content"), F.col("undo_target").alias("_undo")).dropDuplicates(["_p", "_r"])
    own = own.join(target, (F.col(project) == F.col("_p")) & (F.col("restored_from") == F.col("_r")), "left")
    r, action, parent, undo, restored = (F.col(c) for c in ("revision", "action", "parent", "undo_target", "restored_from"))
    back = action.isin("undo", "restore")
    wrong_undo = (
        F.when(action == "create", undo.isNotNull()).when(action.isin("apply", "restore"), ~undo.eqNullSafe(parent))
        .when(action == "undo", ~F.col("_before").eqNullSafe(restored) | ~undo.eqNullSafe(F.col("_undo")))
    )
    return _fired(own, [project, "revision"], {
        "gap": r != F.col("_at"),
        "checksum": ~F.sha2("snapshot", 256).eqNullSafe(F.col("snapshot_hash")),
        "action": ~F.coalesce(((action == "create") & (r == 0)) | ((action == "apply") | back) & (r > 0), F.lit(False)),
        "parent": ~parent.eqNullSafe(F.when(r > 0, r - 1)),
        "undo": wrong_undo,
        "restored": F.when(back, restored.isNull() | (restored < 0) | (restored >= r)).otherwise(restored.isNotNull()),
        "content": back & F.col("_content").isNotNull() & (F.col("_content") != F.sha2("snapshot", 256)),
    })


def snapshot(clips: DataFrame, assets: DataFrame, keys: list[str], source: str) -> DataFrame:
    """What is wrong with placed clips: keys, id, issue. Issues: repeated_id, length (none), before_source, unknown_asset,
    past_source (assets have source and length), overlap (with one before it on its track)."""
    known = assets.select(F.col(source).alias("_known"), F.col("length").alias("_length")).dropDuplicates(["_known"])
    reach = F.max("stop").over(_by(keys, "start", "id").rowsBetween(W.Window.unboundedPreceding, -1))
    n = F.count("*").over(W.Window.partitionBy(*keys, "id"))
    own = clips.withColumns({"_reach": reach, "_n": n}).join(known, F.col(source) == F.col("_known"), "left")
    length = F.col("stop") - F.col("start")
    return _fired(own, [*keys, "id"], {
        "repeated_id": F.col("_n") > 1, "length": length <= 0, "before_source": F.col("source_in") < 0,
        "unknown_asset": F.col(source).isNotNull() & F.col("_known").isNull(),
        "past_source": F.col("source_in") + length > F.col("_length"), "overlap": F.col("_reach") > F.col("start"),
    })


def transcript(words: DataFrame, keys: list[str], before: str | None = None) -> DataFrame:
    """What is wrong with words: keys, pos, issue. Issues: token (not one word), length (none), overlap (with the word before).

    before: the column with the stop of the word before, where rows have it; then no word is dealt out."""
    own = words.withColumn("_before", F.col(before) if before else F.lag("stop").over(_by(keys, "pos")))
    token = F.coalesce(F.col("word").rlike(r"^\S+\z"), F.lit(False))
    return _fired(own, [*keys, "pos"], {"token": ~token, "length": F.col("stop") <= F.col("start"), "overlap": F.col("_before") > F.col("start")})


def media_states(assets: DataFrame, files: DataFrame) -> DataFrame:
    """assets (id, path, sha256) as id, state: online, changed, unbound (no sha256), missing (no such file in files: path, sha256)."""
    found = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha")).dropDuplicates(["_path"])
    own = assets.join(found, F.col("path") == F.col("_path"), "left")
    state = F.when(F.col("_path").isNull(), "missing").when(F.col("sha256").isNull(), "unbound").when(F.col("sha256") == F.col("_sha"), "online").otherwise("changed")
    return own.select("id", state.alias("state"))


def relinked(assets: DataFrame, files: DataFrame) -> DataFrame:
    """New paths by content: id, path of assets whose file is missing, the least path in files of their sha256."""
    there = files.select("path").distinct()
    lost = assets.where("sha256 is not null").join(there, "path", "left_anti").drop("path")
    return lost.join(files.groupBy("sha256").agg(F.min("path").alias("path")), "sha256").select("id", "path")


def after_failure(jobs: DataFrame) -> DataFrame:
    """jobs (cancelled, attempt, most, code) with status: queued again, or cancelled, interrupted, failed.

    Again only if not cancelled, most is from 1 to 3, attempts are left and the code may pass by itself."""
    passing = F.col("code").isin("TOOL_FAILED", "TOOL_TIMEOUT", "WORKER_INTERRUPTED")
    again = ~F.col("cancelled") & F.col("most").between(1, 3) & (F.col("attempt") < F.col("most")) & F.coalesce(passing, F.lit(False))
    end = F.when(F.col("cancelled"), "cancelled").when(F.col("code") == "WORKER_INTERRUPTED", "interrupted").otherwise("failed")
    return jobs.withColumn("status", F.when(again, "queued").otherwise(end))


def locked(clips: DataFrame, tracks: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    """The chosen clips that stand on locked tracks (keys, locked)."""
    return clips.where(chosen).join(tracks.where("locked").select(*keys).distinct(), keys, "left_semi")


def cycles(edges: DataFrame, deepest: int) -> DataFrame:
    """Nodes of edges (parent, child) that reach themselves within `deepest` steps: node, steps (the fewest)."""
    from splicework.operators.snapshots import descendants

    return descendants(edges, deepest).where("parent = child").select(F.col("parent").alias("node"), F.col("depth").alias("steps"))
