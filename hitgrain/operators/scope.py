"""Which uploads and lines belong to a waypoint.

A scope is a table with one row per (waypoint, upload). All limits are joins
on keys, never long literal lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgrain.operators.coverage import WAYPOINT, line_coverage, lines_of_days

SCOPE = ("project_id", "commit_id", "upload_id", "tag", "total_lines", "source_commit", "ingest_date")


def _scope_columns(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("source_commit", F.col("commit_id")).withColumn(
        "ingest_date", F.to_date("ingest_time")
    )


def scope_uploads(uploads: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Uploads made on the waypoint's own commit (and in its upload list, when it names one)."""
    keys = list(WAYPOINT) + (["upload_id"] if "upload_id" in waypoints.columns else [])
    return _scope_columns(uploads).join(waypoints.select(*keys), keys, "left_semi").select(*SCOPE)


def scope_carryforward(uploads: DataFrame, carried: DataFrame) -> DataFrame:
    """Uploads of the (commit, tag) pairs carried forward to a waypoint, within its project."""
    pairs = carried.select("project_id", F.col("commit_id").alias("head"), "source_commit", "tag")
    sources = _scope_columns(uploads).drop("commit_id")
    return (
        sources.join(pairs, ["project_id", "source_commit", "tag"])
        .withColumnRenamed("head", "commit_id")
        .select(*SCOPE)
    )


def scope_union(own: DataFrame, carried: DataFrame) -> DataFrame:
    """Both scopes without duplicates."""
    return own.unionByName(carried).dropDuplicates([*WAYPOINT, "upload_id"])


def scope_uploads_or_carryforward(uploads: DataFrame, waypoints: DataFrame, carried: DataFrame) -> DataFrame:
    return scope_union(scope_uploads(uploads, waypoints), scope_carryforward(uploads, carried))


def scope_partitions(lines: DataFrame, dates: DataFrame) -> DataFrame:
    """Lines of the wanted ingest days. On a table partitioned by day this prunes folders at run time."""
    return lines_of_days(lines, dates)


def partition_union(own: DataFrame, carried: DataFrame) -> DataFrame:
    """Ingest days needed by each waypoint's own and carried-forward uploads."""
    columns = [*WAYPOINT, "ingest_date"]
    return own.select(*columns).unionByName(carried.select(*columns)).distinct()


def scope_diff_lines(df: DataFrame, diff: DataFrame) -> DataFrame:
    """Rows whose (waypoint, file, line) was added by the waypoint's diff; files match by equality."""
    keys = [*WAYPOINT, "file_name", "line_number"]
    return df.join(diff.select(*keys), keys, "left_semi")


def diff_line_states(df: DataFrame, diff: DataFrame) -> DataFrame:
    """Line states of the added lines, each with its ``diff_index``, from one join with the diff.

    ``diff`` has one row per (waypoint, file, line), so the index changes no group.
    """
    keys = [*WAYPOINT, "file_name", "line_number"]
    return line_coverage(df.join(diff.select(*keys, "diff_index"), keys), [*WAYPOINT, "diff_index"])
