"""A training corpus from ``documents``: five stages, each stored before the next reads it.

Toxic documents go; lines that repeat an earlier one go, and documents that lose all
their lines; of near-duplicates the smallest id stays; documents with benchmark
passages go; and what is left is mixed to the target weights of its sources, one row
per copy. All stages but the last return the columns of ``documents``; the last adds
``copy``, which counts a document's rows from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtally.llm.decontamination import drop_contaminated
from gridtally.llm.linededup import drop_repeated_lines
from gridtally.llm.mixing import mix_sources
from gridtally.llm.nearduplicates import drop_near_duplicates
from gridtally.llm.toxicity import drop_toxic
from gridtally.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The toxicity stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
