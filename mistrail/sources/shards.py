"""Shards: compressed text files with one match, or part of one, as JSON per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, match_id, received_at, body) of the lines of ``path`` (files or a pattern, .gz or plain).

    line_id is unique, and in order within a file; match_id is null, as the body has it; received_at is the file's time.
    A gzip file is one task, so large corpora should come in many files. Empty lines are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("received_at"))
    return lines.filter("length(trim(value)) > 0").select(F.monotonically_increasing_id().alias("line_id"), F.lit(None).cast("string").alias("match_id"), "received_at", F.col("value").alias("body"))
