"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, source weights.

Each stage takes (spark, docs, sf_dir), works on what the one before it kept and returns a
DataFrame that is written as Parquet and read again. All but the last return the columns of
documents; the last returns the mix, a row a document that it takes, with its copies.

Defined cases: those of the operators; a document without id passes every stage unless its text
decides otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import dart_minhash, decontaminate, mixing, pii, quality
from tideline.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the positive-unlabelled classifier rejects."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return dart_minhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data in the texts."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their sizes, targets and copies."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("mix", mixing_stage),
]

#: SQL can express neither the classifier nor the drawn copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one after another, through the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
