"""Cleaning of a document corpus, from raw rows to a mixed training set.

    toxicity         documents predicted to be toxic go
    near_dedup       the document of the smallest id of each group of near-duplicates (word shingles of five, 0.8) stays
    decontamination  documents with a benchmark passage go
    pii              personal data in the text gives way to its kind in brackets
    mixing           documents are replicated to the target weights of their sources and dealt out anew

Each stage works on the whole output of the one before, written as Parquet and read again. An empty table passes through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common, decontamination, mixing, near_duplicates, pii, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").where(~common.is_held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_near_duplicates(docs, shingle=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_passages),
    ("pii", personal_data),
    ("mixing", mixed_sources),
]

#: Toxicity and near-duplicates cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
