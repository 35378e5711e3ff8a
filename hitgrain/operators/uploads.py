"""Questions about uploads: summaries, tag availability, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitgrain.operators.coverage import WAYPOINT


def time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def upload_summary(uploads: DataFrame, waypoints: DataFrame) -> DataFrame:
    """One row per upload of each waypoint with its ingest time and tag; a waypoint without uploads has one of nulls."""
    rows = uploads.select(
        *WAYPOINT,
        "upload_id",
        time_text("ingest_time").alias("ingest_time"),
        F.col("tag").alias("tag_name"),
        F.col("total_lines").alias("successfully_uploaded_lines"),
    )
    return waypoints.select(*WAYPOINT).join(rows, list(WAYPOINT), "left")


def commit_tags(uploads: DataFrame) -> DataFrame:
    """Distinct (project, commit, tag): the flat form of tag availability used by joins."""
    return uploads.select(*WAYPOINT, "tag").distinct()


def uploads_per_tag(uploads: DataFrame) -> DataFrame:
    """Line count and ingest time of every upload of each (project, commit, tag)."""
    return uploads.select(
        *WAYPOINT,
        "tag",
        "upload_id",
        F.col("total_lines").alias("successfully_uploaded_lines"),
        time_text("ingest_time").alias("ingest_time"),
    )


def tag_availability(uploads: DataFrame, commits: DataFrame) -> DataFrame:
    """Per tag of a project, the commits (of those asked for) that have it, one row per upload."""
    asked = uploads.join(commits.select(*WAYPOINT), list(WAYPOINT), "left_semi")
    return uploads_per_tag(asked).withColumnRenamed("tag", "tag_name")


def uploaded_tags(uploads: DataFrame) -> DataFrame:
    return uploads.select("project_id", F.col("tag").alias("tag_name")).distinct()


def report_size(scope: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Uploaded line counts of all uploads in scope, own and carried forward."""
    sizes = scope.groupBy(*WAYPOINT).agg(F.sum("total_lines").alias("size"))
    return (
        waypoints.select(*WAYPOINT)
        .join(sizes, list(WAYPOINT), "left")
        .select(*WAYPOINT, F.coalesce("size", F.lit(0)).alias("size"))
    )


def latest_upload(uploads: DataFrame, waypoints: DataFrame) -> DataFrame:
    latest = uploads.groupBy(*WAYPOINT).agg(F.max("ingest_time").alias("latest_ingest_time"))
    return waypoints.select(*WAYPOINT).join(latest, list(WAYPOINT), "left")
