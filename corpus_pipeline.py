"""A corpus pipeline of four stages, each an operator of tracewell.llm over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import near_dup, packing, pii, quality
from tracewell.session import read_table, scratch


# What a stage does with nulls, empty and very long texts, ties, repeated rows and further columns is what its operator
# states: null and empty texts fail the quality rules; null hosts are one host; null ids pass all stages; of equal rows
# one stays; all columns are handed on, whatever their names. An empty table gives an empty one after each stage.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: four fifths of the 5-word shingles in common."""
    return near_dup.keep_first_copies(docs, width=5, per_cent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", sanitise), ("packing", pack)]

#: Hash functions and a tokeniser can't be had in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
