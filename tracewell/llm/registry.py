"""The opN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import flat_files, main_text, near_dup, neighbours, packing, pii, quality, segmentations, sharding, warc
from tracewell.session import read_table, spread


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(spread(read_table(spark, sf_dir, "documents")))


def op1_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations.sample_segmentations(spread(read_table(spark, sf_dir, "documents")))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(spread(read_table(spark, sf_dir, "pages")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, read_table(spark, sf_dir, "pages"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(spread(read_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read_table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op9_flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_files.flat_token_files(spark, read_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spread(read_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_segmentations": op1_segmentations,
    "op2_main_text": op2_main_text,
    "op6_neighbours": op6_neighbours,
    "op7_warc": op7_warc,
    "op4_sharding": op4_sharding,
    "op9_flat_files": op9_flat_files,
    "op3_personal_data": op3_personal_data,
    "op8_packing": op8_packing,
    "op5_near_duplicates": op5_near_duplicates,
    "op10_host_quality": op10_host_quality,
}
ORACLE_SQL = {
    "op7_warc": warc.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op10_host_quality": quality.ORACLE_SQL,
}
