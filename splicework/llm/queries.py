"""The numbered queries: name -> callable(spark, sf_dir). Each is a thin view of its operator's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicework.llm import decontaminate, interpolated_lm, line_rules, mixing, pii, quality, simhash, token_counts, url_filter, warc
from splicework.llm.common import fold, table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


TOKENIZERS = "/opt/tokenizers"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("record_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.scored(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= quality.CUT).cast("int").alias("predicted"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str, model_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), token_counts.zipf_pieces(model_file))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_simhash, op3_warc, op4_quality, op5_lm, op6_line_rules, op7_token_counts, op8_url_filter, op9_pii, op10_mixing)
}
