"""The stored line and upload tables, as the sinks write them, read back as the tables that reports take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.functions import lines as L


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """Typed lines with their ``ingest_date``, by which the table is partitioned.

    Only the columns that a line state needs are read, and reports read only the days of the uploads in their scope.
    """
    return spark.read.parquet(path).select(
        "upload_id",
        "file_name",
        F.col("line_number").cast("int").alias("line_number"),
        "type",
        L.extract_line_hits(F.col("metadata")).alias("hits"),
        L.extract_branch_hits(F.col("metadata")).alias("branch_hits"),
        F.col("ingest_date").cast("date").alias("ingest_date"),
    )


def stored_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(
        "upload_id", "project_id", "commit_id", "tag", "ingest_time", F.col("total_lines").cast("long").alias("total_lines")
    )
