"""Line comments for the lines of a diff: missing-coverage blocks and partial branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.functions import lines as L
from hitgrain.operators.coverage import WAYPOINT


def missing_coverage_blocks(lines: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """Merge consecutive lines that are not covered into blocks.

    ``line_number - diff_index`` is constant along an unbroken run of added
    lines, so runs are grouped by key instead of by looking at neighbours. The
    window then spans one run of added lines of one file. Inside a run a method
    or covered line opens a new segment. A segment's block starts at its first
    line that is neither covered nor a branch and ends at the segment's last line.
    Without ``diff`` the lines bring their ``diff_index``, as those of ``diff_line_states`` do.
    """
    keys = [*WAYPOINT, "file_name", "line_number"]
    indexed = lines if diff is None else lines.join(diff.select(*keys, "diff_index"), keys, "left")
    run = F.when(
        F.col("diff_index").isNotNull(), F.concat(F.lit("run"), F.col("line_number") - F.col("diff_index"))
    ).otherwise(F.concat(F.lit("line"), F.col("line_number")))
    group = [*WAYPOINT, "file_name", "run"]
    opens = (F.col("contains_method") | (F.col("state") == L.COVERED)).cast("int")
    segment = F.sum(opens).over(Window.partitionBy(*group).orderBy("line_number"))
    startable = ~F.col("contains_branch") & (F.col("state") != L.COVERED)
    start = F.min(F.when(startable, F.struct("line_number", "contains_method")))
    return (
        indexed.withColumn("run", run)
        .withColumn("segment", segment)
        .groupBy(*group, "segment")
        .agg(start.alias("start"), F.max("line_number").alias("end_line"))
        .filter(F.col("start").isNotNull())
        .select(
            *WAYPOINT,
            "file_name",
            F.col("start.contains_method").alias("starts_on_method"),
            F.col("start.line_number").alias("start_line"),
            "end_line",
        )
    )


def partial_branch_comments(lines: DataFrame) -> DataFrame:
    """Branch lines that are not covered and have branches left to cover."""
    return lines.filter(
        F.col("contains_branch")
        & (F.col("state") != L.COVERED)
        & (F.col("covered_branches") != F.col("total_branches"))
    ).select(*WAYPOINT, "file_name", "line_number", "total_branches", "covered_branches")


def line_comments(blocks: DataFrame, partials: DataFrame, settings: DataFrame) -> DataFrame:
    """Both kinds of comments, partial branches first; none for repositories that hide them."""
    branch = partials.select(
        *WAYPOINT,
        "file_name",
        F.col("line_number").alias("start_line"),
        F.col("line_number").alias("end_line"),
        F.lit(0).alias("position"),
        F.lit("PARTIAL_BRANCH_LINE_COMMENT").alias("comment_type"),
        F.lit(False).alias("starts_on_method"),
        "total_branches",
        "covered_branches",
    )
    none = F.lit(None).cast("bigint")
    missing = blocks.select(
        *WAYPOINT,
        "file_name",
        "start_line",
        "end_line",
        F.lit(1).alias("position"),
        F.lit("MISSING_COVERAGE_LINE_COMMENT").alias("comment_type"),
        "starts_on_method",
        none.alias("total_branches"),
        none.alias("covered_branches"),
    )
    hidden = settings.filter(F.col("line_comment_type") == "hidden").select(
        F.col("repository_id").alias("project_id")
    )
    return branch.unionByName(missing).join(hidden, "project_id", "left_anti")
