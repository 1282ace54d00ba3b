"""A training corpus from raw documents, in five stages: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the last return the
columns of their documents; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, hostrules, packing, pii, simhash
from tallyloom.llm.tables import frozen, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule go, and in rejected hosts those that fail any rule."""
    return hostrules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay unchanged."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024, one row per piece."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("decontamination", benchmark_passages),
          ("personal data", personal_data), ("packing", packed)]

#: SQL has no simhash and no tokenizer; tests/llm/test_pipeline.py holds the pipeline against a plain Python one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
