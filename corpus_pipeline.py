"""Corpus pipeline: language ID, exact dedup, near-duplicate join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Stages hand over
Parquet tables; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing
from docloom.llm.common import read_table, write_shared


def _small_batches(spark: SparkSession) -> None:
    """Whole rows go through Arrow here, and their texts are long: fewer rows a batch bound the memory of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    _small_batches(spark)
    return language_id.recognised_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard_join.first_of_groups(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    _small_batches(spark)
    return decontaminate.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken of a document."""
    return mixing.mixed_rows(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("decontaminate", decontaminated), ("mixing", mixed)]

#: The language model and random rounding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
