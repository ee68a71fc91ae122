"""URL filter: rules by host and path first, then a character language-model ratio.

The method: two smoothed variable-order Markov models, one of accepted and one of rejected URLs (those
that the rules decide), over normalised characters of host and path: lower case, each digit 0, anything
but a-z 0 . / _ - written ~. Orders two, one and none are mixed by Witten-Bell smoothing, from a uniform
floor. A URL's score is the sum of its characters' log-likelihood differences (accepted less rejected)
by its length. A quarter of the URLs that rules decide, by a digest of the URL, is held out of the models: the
threshold is calibrated on them, to the best mean of the two classes' accuracies, which accuracy() tells.

The table of scores is an array with a place for each trigram over an alphabet of ALPHABET signs, ALPHABET ** 3
numbers (39,304) whatever the number of URLs, and stands in the plan as one constant. Each URL is scored in place, by a
fold over its signs: no row is dealt out, joined or grouped.

Null URLs and those without "://" have an empty host and path, match no rule, and are scored by their end
sign alone. Without examples of both classes (held out too), the verdict is allow. Repeated rows and null ids get a
result each; of rules of equal length that fit, the one listed last wins. An empty table gives no rows, and other
columns of the table are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: (host, path, verdict)
Rule = tuple[str, str, str]
SIGNS = "^$~0./_-abcdefghijklmnopqrstuvwxyz"  # start, end, any other, any digit
ALPHABET = len(SIGNS)
#: First hexadecimal digits of the digests of held-out URLs: a quarter.
HELD_OUT = "0123"
MILLION = 1_000_000
#: Scores are floored to bins of BIN millionths for calibration, from -BINS to BINS.
BIN, BINS = 10_000, 2_000


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, as text, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def signs(host_path: Column) -> Column:
    """^^, the normalised characters, $."""
    known = F.regexp_replace(F.regexp_replace(F.lower(host_path), F.lit("[0-9]"), F.lit("0")), F.lit(r"[^a-z0./_-]"), F.lit("~"))  # lower() may lengthen a text
    return F.concat(F.lit("^^"), known, F.lit("$"))


def trigrams(text: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def model(grams: DataFrame) -> DataFrame:
    """gram, score (millionths): from rows of gram and the counts allow and block, the log-likelihood difference of its last sign."""
    g = grams.select("gram", *(F.col(c).cast("double").alias(c) for c in ("allow", "block")), F.substring("gram", 1, 2).alias("c2"), F.substring("gram", 2, 2).alias("b2"), F.substring("gram", 2, 1).alias("c1"), F.substring("gram", 3, 1).alias("x"))
    w2, wb, w1, w0 = W.Window.partitionBy("c2"), W.Window.partitionBy("b2"), W.Window.partitionBy("c1"), W.Window.partitionBy(F.lit(0))
    wx, first = W.Window.partitionBy("x"), lambda w: w.orderBy("gram")
    for c in ("allow", "block"):
        g = g.withColumns({f"{c}_b": F.sum(c).over(wb), f"{c}_x": F.sum(c).over(wx), f"{c}_n": F.sum(c).over(w0)})
        g = g.withColumns({f"{c}_c2": F.sum(c).over(w2), f"{c}_c1": F.sum(c).over(w1)})
        # distinct followers: of a context, the pairs (context, sign) that occur
        g = g.withColumn(f"{c}_t2", F.sum((F.col(c) > 0).cast("double")).over(w2))
        g = g.withColumns({f"{c}_b1": ((F.row_number().over(first(wb)) == 1) & (F.col(f"{c}_b") > 0)).cast("double"), f"{c}_x1": ((F.row_number().over(first(wx)) == 1) & (F.col(f"{c}_x") > 0)).cast("double")})
        g = g.withColumns({f"{c}_t1": F.sum(f"{c}_b1").over(w1), f"{c}_t0": F.sum(f"{c}_x1").over(w0)})

    def mixed(c: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for count, total, kinds in ((f"{c}_x", f"{c}_n", f"{c}_t0"), (f"{c}_b", f"{c}_c1", f"{c}_t1"), (c, f"{c}_c2", f"{c}_t2")):
            p = F.when(F.col(total) > 0, (F.col(count) + F.col(kinds) * p) / (F.col(total) + F.col(kinds))).otherwise(p)
        return p

    return g.select("gram", F.round((F.log(mixed("allow")) - F.log(mixed("block"))) * MILLION).cast("long").alias("score"))


def score_array(table: DataFrame) -> np.ndarray:
    """The scores by place of the trigram, read in base ALPHABET; those that no training URL has are not asked for."""
    out = np.zeros(ALPHABET**3, np.int64)
    for r in table.collect():  # ALPHABET ** 3 rows at most
        a, b, c = (SIGNS.index(x) for x in r["gram"])
        out[(a * ALPHABET + b) * ALPHABET + c] = r["score"]
    return out


def place_sum(text: Column, scores: np.ndarray) -> Column:
    """The sum of the scores of the text's trigrams."""
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(SIGNS), c) - 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] % ALPHABET**2 * ALPHABET + x
        more = F.when(s["n"] >= 2, F.get(F.lit(scores), at)).otherwise(0)
        return F.struct(at.alias("at"), (s["n"] + 1).alias("n"), (s["sum"] + more).cast("long").alias("sum"))

    return F.aggregate(places, start, step, lambda s: s["sum"])


def calibrated(scored: DataFrame) -> tuple[int, float] | None:
    """The threshold in bins from rows with a rule's verdict, and the mean of the classes' accuracies there. Reads BINS * 2 + 1 rows at most."""
    bins = scored.where("by_rule is not null").groupBy("bin").agg(*(F.count_if(F.col("by_rule") == c).alias(c) for c in ("allow", "block")))
    rows = sorted(bins.collect())
    allow, block = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not allow or not block:
        return None
    best, at, above, below, last = -1, 0, allow, 0, rows[0]["bin"] - 1
    for r in rows:  # the threshold stands halfway between the bin before and this one
        if (value := above * block + below * allow) > best:
            best, at = value, (last + r["bin"] + 1) // 2
        last = r["bin"]
        above, below = above - r["allow"], below + r["block"]
    return at, best / (2 * allow * block)


def _scored(pages: DataFrame, rules: list[Rule], id_col: str, url_col: str) -> tuple[DataFrame, tuple[int, float] | None]:
    """id, host, path, rule, by_rule, score, bin; and what is calibrated on the held-out URLs."""
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1).alias("digit"))
    name, verdict = matched_rule(rules)
    own = own.withColumns({"rule": name, "by_rule": verdict, "signs": signs(F.concat("host", "path"))})
    held = F.instr(F.lit(HELD_OUT), F.col("digit")) > 0
    learned = own.where(~held & F.col("by_rule").isNotNull()).select("by_rule", trigrams(F.col("signs")).alias("gram"))
    counted = learned.groupBy("gram").agg(*(F.count_if(F.col("by_rule") == c).alias(c) for c in ("allow", "block")))
    every = pages.sparkSession.createDataFrame([(a + b + c,) for a in SIGNS[0] + SIGNS[2:] for b in SIGNS[0] + SIGNS[2:] for c in SIGNS[1:]], "gram string")
    grams = every.join(counted, "gram", "left").select("gram", F.coalesce("allow", F.lit(0)).alias("allow"), F.coalesce("block", F.lit(0)).alias("block"))
    total = place_sum(F.col("signs"), score_array(model(grams)))
    scored = own.withColumn("score", F.floor(total / (F.length("signs") - 2)).cast("long"))
    scored = scored.withColumn("bin", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).cast("int"))
    return scored, calibrated(scored.where(held))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per URL: id, host, path, rule, verdict, score (millionths a character)."""
    scored, found = _scored(pages, rules, id_col, url_col)
    by_model = F.lit("allow") if found is None else F.when(F.col("bin") >= found[0], "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def accuracy(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> float | None:
    """The mean of the two classes' accuracies on held-out URLs, at the threshold; None without both classes."""
    found = _scored(pages, rules, id_col, url_col)[1]
    return found and found[1]
