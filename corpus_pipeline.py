"""The corpus pipeline: classify, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet in
the shared folder and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicework.llm import decontaminate, mixing, near_copies, pii, quality
from splicework.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labels of documents that are still there."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("quality_score") >= quality.CUT).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.deduplicated(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its text and columns, its size in words and how many of its words the mix takes."""
    mixed = mixing.with_taken(docs)
    return mixed.withColumnsRenamed({f"mix_{c}": c for c in ("size", "source_size", "target", "taken")})


STAGES = [
    ("classify", classify),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate_docs),
    ("redact", redact),
    ("mix", mix),
]
#: Its first two stages are not SQL; tests/llm hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
