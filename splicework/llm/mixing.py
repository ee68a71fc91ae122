"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac(i * golden ratio), in integers: (i * GOLDEN) mod 2^31. The point falls into a
source's share of the cumulative weights; the source's slots are ranked in order, and the slot of rank r takes block
r mod (its blocks) of the source. A source's weight in the schedule is half its share of the targets and half an even
share, so that the smallest source has slots too. Its blocks are the runs of equal numbers of tokens in its shuffled
documents (by a digest of their ids), as many as let its slots reach its target; the slot that reaches the target is
cut there, to the word. So each source takes its target, rounded to a whole word, whatever its size, and its blocks
lie evenly over the schedule. Targets are at most MOST_COPIES times a source's size, so no document is taken more often.

Scale. Sources are a small dimension: their totals come to the driver, MAX_SOURCES at most (more raise an
error). A source's documents are ordered in spans of about SPAN documents each, by their digests; totals of spans give
each span's place. The schedule has SLOTS slots, or EACH a source if that is more; ranks are counted per stretch of
slots first. Documents meet the blocks that their ends fall into by joins on source and block.

Null texts have size 0, as have those without a word; they take 0. A null source is a source of its own,
the last. Repeated rows and null ids are documents of their own. Equal digests are ordered by size and
text digest. Empty tables give no rows. Other columns, of any name, are kept by with_taken().
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from splicework.llm.common import ROW, n_words, numbered, written

GOLDEN, MODULUS = 1_327_217_885, 2**31
SLOTS, EACH, MAX_SOURCES, SPAN, STRETCH, BINS = 65_536, 128, 100_000, 20_000, 1_024, 4_096
WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), Fraction(3, 2), 2


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_COPIES) -> list[Fraction]:
    """Tokens wanted of each source: share of all sizes by weight; what is above most times a size is shared again.

    The fixed point is a water level: in order of most * size / weight, a source is full if the level that
    the ones after it would have is above its own."""
    want, open_weight, out = share * sum(sizes), sum(weights[i % len(weights)] for i in range(len(sizes))), [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i % len(weights)])):
        w = weights[i % len(weights)]
        mine = min(want * w / open_weight, Fraction(most * sizes[i]))
        out[i], want, open_weight = mine, want - mine, open_weight - w
    return out


def edges(shares: list[Fraction]) -> list[tuple[int, int, int]]:
    """(source index, first point, point after the last) by weights of half the share of the targets and half an even share."""
    total, n, at, before, out = sum(shares), len(shares), 0, Fraction(0), []
    for i, x in enumerate(shares):
        before += x
        end = int(before * MODULUS / (2 * total)) + (i + 1) * MODULUS // (2 * n)
        out.append((i, at, end))
        at = end
    return out


def ranked(df: DataFrame, key: str, order: Column, value: Column | None = None) -> DataFrame:
    """Adds _before: the running number of rows (or sum of value) before each row of a key in order, summed per stretch first."""
    value = F.lit(1).cast("long") if value is None else value
    own = df.withColumns({"_order": order, "_value": value, "_stretch": F.floor(order / STRETCH)})
    before = lambda w: F.coalesce(F.sum("_value").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    sums = own.groupBy(key, "_stretch").agg(F.sum("_value").alias("_value")).withColumn("_base", before(W.Window.partitionBy(key).orderBy("_stretch"))).drop("_value")
    own = own.withColumn("_within", before(W.Window.partitionBy(key, "_stretch").orderBy("_order"))).join(sums, [key, "_stretch"])
    return own.withColumn("_before", F.col("_base") + F.col("_within")).drop("_order", "_value", "_stretch", "_base", "_within")


def schedule(spark, shares: list[Fraction], n_slots: int) -> DataFrame:
    """slot, source index, rank of the slot among the source's slots (from 0)."""
    width = MODULUS // BINS
    ranges = spark.createDataFrame([e for e in edges(shares) if e[1] < e[2]], "source int, lo long, hi long")
    ranges = ranges.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % MODULUS).alias("point"))
    slots = slots.withColumn("bin", F.expr(f"point div {width}")).join(ranges, "bin").where("point >= lo and point < hi").select("slot", "source")
    return ranked(slots, "source", F.col("slot")).withColumnRenamed("_before", "rank")


def with_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs and mix_size, mix_source_size, mix_target, mix_taken (in place of columns of these names)."""
    added = {c: f"mix_{c}" for c in ("size", "source_size", "target", "taken")}
    rows = numbered(docs, "mix-rows")
    # only narrow rows are dealt out by source and block; whole rows meet their result once
    own = _taken(written(rows.select(ROW, *_narrow(id_col, text_col, source_col)), "mix-sizes")).select(ROW, *(F.col(c).alias(a) for c, a in added.items()))
    kept = rows.select(ROW, *(c for c in docs.columns if c not in added.values()))
    return kept.join(own, ROW).drop(ROW)


def _narrow(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).alias("name"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document: id, size, source_size, target, taken."""
    own = docs.select(*_narrow(id_col, text_col, source_col))
    return _taken(written(own, "mix-sizes")).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def slots_of(n_sources: int) -> int:
    return max(SLOTS, EACH * n_sources)


def _taken(sized: DataFrame) -> DataFrame:
    """Rows of id, name, size, tie and others, with source_size, target, taken."""
    spark = sized.sparkSession
    rows = sized.groupBy("name").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy(F.col("name").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [int(r["n"]) for r in rows]
    want = targets(sizes)
    fields = "_name string, _source int, source_size long, target double, _goal long, _spans long"
    sources = spark.createDataFrame([(r["name"], i, n, float(t), int(t + Fraction(1, 2)), -(-r["rows"] // SPAN)) for i, (r, n, t) in enumerate(zip(rows, sizes, want, strict=True))], fields)
    sources = F.broadcast(sources)  # MAX_SOURCES rows at most, as are counts
    own = sized.join(sources, sized["name"].eqNullSafe(sources["_name"])).drop("_name")
    if not sum(sizes):
        return own.withColumn("taken", F.lit(0).cast("long"))
    # a document's place in its source's stream: spans are ranges of digests
    own = own.withColumn("_digest", F.md5(F.coalesce(F.col("id").cast("string"), F.col("tie").cast("string"))))
    own = own.withColumn("_span", F.floor(F.conv(F.substring("_digest", 1, 7), 16, 10).cast("long") * F.col("_spans") / 2**28))
    spans = own.groupBy("_source", "_span").agg(F.sum("size").alias("n"))
    spans = ranked(spans, "_source", F.col("_span"), F.col("n")).select("_source", "_span", F.col("_before").alias("_base"))
    within = W.Window.partitionBy("_source", "_span").orderBy("_digest", "size", "tie").rowsBetween(W.Window.unboundedPreceding, -1)
    own = own.withColumn("_from", F.coalesce(F.sum("size").over(within), F.lit(0))).join(spans, ["_source", "_span"])
    own = own.withColumn("_from", F.col("_from") + F.col("_base")).withColumn("_to", F.col("_from") + F.col("size"))
    # slots: block k of n holds tokens k * size div n up to (k + 1) * size div n of the stream
    slots = schedule(spark, want, slots_of(len(rows)))
    counts = slots.groupBy(F.col("source").alias("_source")).count().join(sources.where("_goal > 0"), "_source")
    counts = F.broadcast(counts.select("_source", "source_size", "_goal", F.expr("greatest(1, `count` * source_size div _goal)").alias("_n")))
    slots = slots.join(counts, F.col("source") == F.col("_source")).withColumns({"_block": F.expr("rank % _n"), "_round": F.expr("rank div _n")})
    slots = slots.withColumns({"_start": F.expr("_block * source_size div _n"), "_len": F.expr("(_block + 1) * source_size div _n - _block * source_size div _n")})
    slots = slots.withColumn("_take", F.greatest(F.lit(0), F.least("_len", F.col("_goal") - F.col("_round") * F.col("source_size") - F.col("_start"))))
    # of each block: how often it is taken whole, the length of the part that is taken once more, and tokens taken before it
    times = slots.groupBy("_source", "_block", "_start").agg(F.count_if(F.col("_take") == F.col("_len")).alias("_times"), F.max(F.when(F.col("_take") < F.col("_len"), F.col("_take"))).alias("_part"), F.sum("_take").alias("_sum"))
    times = ranked(times, "_source", F.col("_block"), F.col("_sum")).drop("_sum")
    own = own.join(F.broadcast(counts.select("_source", "_n")), "_source", "left")
    # tokens taken of the source's stream up to a document's start and up to its end
    for end, at, of in (("_a", F.col("_from"), F.col("_from")), ("_b", F.col("_to"), F.col("_to") - 1)):
        own = own.withColumn("_at", of).withColumn("_block", F.expr("if(size > 0, ((_at + 1) * _n - 1) div source_size, -1 - pmod(tie, 1024))")).join(times, ["_source", "_block"], "left")
        inside = at - F.col("_start")
        reached = F.col("_before") + F.col("_times") * inside + F.least(inside, F.coalesce("_part", F.lit(0)))
        own = own.withColumn(end, F.coalesce(reached, F.col("_goal"))).drop("_at", "_block", "_start", "_times", "_part", "_before")
    taken = F.when((F.col("size") > 0) & F.col("_n").isNotNull(), F.col("_b") - F.col("_a")).otherwise(0)
    return own.withColumn("taken", taken.cast("long"))
