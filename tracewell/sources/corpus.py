"""Corpus sources: JSON lines that keep malformed rows, pinned files, report and CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import text as T


def parse_jsonl(lines: DataFrame, slug: str) -> DataFrame:
    """line_no, raw, record_sha256, record_uid, value (null where malformed). lines: line_no, raw."""
    sha = T.record_hash(F.col("raw"))
    out = lines.filter(F.trim("raw") != "").withColumn("record_sha256", sha)
    return out.withColumns({"record_uid": T.record_uid(F.lit(slug), F.col("line_no"), F.col("record_sha256")), "value": F.try_parse_json("raw"), "malformed": F.try_parse_json("raw").isNull()})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, raw of text files. Files are read in splits; a line's number is its place in the split and the lines of the splits before."""
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    # a row for each split
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "split", "first", before.alias("before"))
    return lines.join(placed, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def read_jsonl(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """The records of JSON-lines files, with line numbers, malformed ones too; blank lines count but give none."""
    return parse_jsonl(numbered_lines(spark, path), slug)


def pinned_file(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and bytes of local files; URLs and network shares are refused."""
    import re

    if re.match(r"^(?:[a-z][a-z0-9+.-]*://|\\\\|//)", path, re.I) and not path.startswith("file:"):
        raise ValueError("only local files can be pinned")
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def merge_shards(shards: list[DataFrame], same: tuple[str, ...] = ("fingerprint",)) -> DataFrame:
    """The union of shards; reading it fails where they disagree on one of the columns `same` (corpus, plan, revision)."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    for name in same:
        kinds = out.agg(F.count_distinct(name) + F.max(F.col(name).isNull().cast("int"))).scalar()
        out = out.filter(F.assert_true(F.coalesce(kinds, F.lit(0)) <= 1, F.lit(f"shards differ in {name}")).isNull())
    return out


def rate_text(rate):
    """Six decimals, empty where there is no rate."""
    return F.when(rate.isNull(), F.lit("")).otherwise(F.format_string("%.6f", rate))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)
