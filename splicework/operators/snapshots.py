"""Registry search, revisions, semantic differences and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.operators.tables import written


def search(assets: DataFrame, bin_prefix: list[str], tags: list[str], text: str) -> DataFrame:
    """Assets in a bin (a path prefix) with all tags and, in any letter case, text in id, title, bin or tags."""
    found = assets
    if bin_prefix:
        found = found.where(F.slice("bin", 1, len(bin_prefix)) == F.array(*map(F.lit, bin_prefix)))
    for t in tags:
        found = found.where(F.array_contains("tags", t))
    if text:
        hay = F.concat(F.array(F.col("id").cast("string"), F.col("title")), F.col("bin"), F.col("tags"))
        found = found.where(F.exists(hay, lambda s: F.contains(F.lower(s), F.lit(text.lower()))))
    return found


def duplicates(rows: DataFrame, content: Column, id_col: str) -> DataFrame:
    """Contents that two or more rows share: sha256, bytes, n, first_id."""
    own = rows.select(F.col(id_col).alias("id"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))
    return own.groupBy("sha256", "bytes").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row per key that was added, removed or changed."""
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, keys, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(*keys, kind.alias("change"))


def numbered(rows: DataFrame, project: str, *order: str) -> DataFrame:
    """Revisions of each project, from 1."""
    return rows.withColumn("revision", F.row_number().over(W.Window.partitionBy(project).orderBy(*order)))


def history(revisions: DataFrame, project: str, before: Column, n: int) -> DataFrame:
    """The n revisions of each project before a given one, the newest first, and whether there are more."""
    w = W.Window.partitionBy(project).orderBy(F.col("revision").desc())
    own = revisions.where(F.col("revision") < before).withColumns({"place": F.row_number().over(w), "parent": F.lead("revision").over(w)})
    return own.where(F.col("place") <= n).withColumn("more", F.coalesce(F.col("place") == n, F.lit(False)) & F.col("parent").isNotNull())


def descendants(edges: DataFrame, deepest: int) -> DataFrame:
    """parent, child, depth (the least) of all pairs that at most deepest steps connect; a graph of bounded depth."""
    level = edges.select("parent", "child").distinct()
    every = level.withColumn("depth", F.lit(1))
    for depth in range(2, deepest + 1):
        step = edges.select(F.col("parent").alias("child"), F.col("child").alias("_next"))
        level = written(level.join(step, "child").select("parent", F.col("_next").alias("child")).distinct(), "level")
        every = every.unionByName(level.withColumn("depth", F.lit(depth)))
    return every.groupBy("parent", "child").agg(F.min("depth").alias("depth"))


def levels(edges: DataFrame, deepest: int) -> DataFrame:
    """node, level: the longest way (steps) from a node without parents; evaluating by level is a topological order.

    Nodes of level `deepest` may lie deeper, or on or behind a cycle. Nodes on a cycle that none reaches are left out."""
    own = edges.select("parent", "child").distinct()
    level = own.select(F.col("parent").alias("node")).distinct().join(own.select(F.col("child").alias("node")), "node", "left_anti")
    every = level.withColumn("level", F.lit(0))
    for depth in range(1, deepest + 1):
        level = written(own.join(level, own["parent"] == level["node"]).select(F.col("child").alias("node")).distinct(), "level")
        every = every.unionByName(level.withColumn("level", F.lit(depth)))
    return every.groupBy("node").agg(F.max("level").alias("level"))


def edited(rows: DataFrame, edits: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows (keys, values) after edits (keys, op: add, replace or remove; values): one edit a key.

    An edit that does not fit (adding what is there; replacing or removing what is not) changes nothing: see misfits()."""
    there, op = F.col("_old").isNotNull(), F.col("op")
    both = rows.select(*keys, F.struct(*values).alias("_old")).join(edits.select(*keys, "op", F.struct(*values).alias("_new")), keys, "full_outer")
    after = F.when(there & (op == "replace"), F.col("_new")).when(there & F.coalesce(op != "remove", F.lit(True)), F.col("_old")).when(~there & (op == "add"), F.col("_new"))
    return both.select(*keys, after.alias("_row")).where("_row is not null").select(*keys, "_row.*")


def misfits(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edits that cannot be made: keys, issue (exists, missing, or repeated: several edits of one key)."""
    n = F.count("*").over(W.Window.partitionBy(*keys))
    own = edits.select(*keys, "op", n.alias("_n")).join(rows.select(*keys, F.lit(True).alias("_there")).distinct(), keys, "left")
    issue = F.when(F.col("_n") > 1, "repeated").when((F.col("op") == "add") & F.col("_there"), "exists").when((F.col("op") != "add") & F.col("_there").isNull(), "missing")
    return own.select(*keys, issue.alias("issue")).where("issue is not null")


def reached(members: DataFrame, start: DataFrame, node: str, group: str) -> DataFrame:
    """Nodes that share a group with a start node, directly or over any number of others: node, round (the first).

    members are pairs (node, group), such as tracks and the links on them; each round goes from the nodes just found to their
    groups and on to all members of those, until a round finds no new node. Start nodes are of round 0; null groups tie
    nothing. Each round is a table in the shared folder."""
    own = written(members.select(node, group).where(F.col(group).isNotNull()).distinct(), "members")
    new = written(start.select(node).distinct().withColumn("round", F.lit(0)), "reached")
    found, n = new, 0
    while not new.isEmpty():
        n += 1
        groups = own.join(new, node, "left_semi").select(group).distinct()
        more = own.join(groups, group, "left_semi").select(node).distinct().join(found, node, "left_anti")
        new = written(more.withColumn("round", F.lit(n)), "reached")
        found = found.unionByName(new)
    return found
