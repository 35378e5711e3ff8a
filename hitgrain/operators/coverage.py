"""Line states and the total, file and tag figures built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.functions import lines as L

WAYPOINT = ("project_id", "commit_id")
FLAGS = ("contains_method", "contains_branch", "contains_statement")


DAY = "ingest_date"
# Before all days. Spark prunes partitions at run time only by a side that a comparison limits.
NO_DAY = "0001-01-01"


def lines_of_days(lines: DataFrame, days: DataFrame) -> DataFrame:
    """Lines of the wanted ingest days; on a table partitioned by day other folders are not read.

    The days are handed to every task: there is at most one row per day of the calendar, however large the tables are.
    """
    wanted = days.select(DAY).filter(F.col(DAY) >= F.lit(NO_DAY).cast("date")).distinct()
    return lines.join(F.broadcast(wanted), DAY, "left_semi")


def join_upload_lines(scope: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the uploads in scope, with type flags.

    ``scope`` has one row per (waypoint, upload). No broadcast hint: Spark
    broadcasts the scope when its measured size allows and shuffles otherwise. Where both sides know the ingest day,
    only days of the scope are read.
    """
    dated = DAY in scope.columns and DAY in lines.columns
    if dated:
        lines = lines_of_days(lines, scope)
    flagged = lines.select(
        "upload_id", "file_name", "line_number", *L.flag_line_types(F.col("type")), "hits", "branch_hits", *([DAY] if dated else [])
    )
    return scope.join(flagged, ["upload_id", *([DAY] if dated else [])])


def explode_branches(df: DataFrame) -> DataFrame:
    """One row per branch index; a line without branch hits gives its own hits at index 0."""
    values = F.when(F.size("branch_hits") == 0, F.array(F.col("hits"))).otherwise(F.col("branch_hits"))
    return df.select(
        *[c for c in df.columns if c != "branch_hits"], F.posexplode(values).alias("branch_index", "branch_hit")
    )


def branching_lines(df: DataFrame, keys: Sequence[str] = WAYPOINT) -> DataFrame:
    """Combine all uploads by (file, line, branch index).

    Sums and maxima combine on the map side before the shuffle, so a line
    present in very many uploads reaches its reducer as few rows.
    """
    return (
        explode_branches(df)
        .groupBy(*keys, "file_name", "line_number", "branch_index")
        .agg(
            *[F.max(flag).alias(flag) for flag in FLAGS],
            F.sum("hits").alias("hits"),
            (F.sum("branch_hit") > 0).alias("is_branch_hit"),
        )
    )


def line_coverage(df: DataFrame, keys: Sequence[str] = WAYPOINT) -> DataFrame:
    """State of every (file, line) within the given keys."""
    covered_branch = F.col("contains_branch") & F.col("is_branch_hit")
    return (
        branching_lines(df, keys)
        .groupBy(*keys, "file_name", "line_number")
        .agg(
            *[F.max(flag).alias(flag) for flag in FLAGS],
            F.count_if(F.col("contains_branch")).alias("total_branches"),
            F.count_if(covered_branch).alias("covered_branches"),
            L.classify_line_state(F.sum("hits"), F.count_if(covered_branch), F.min("is_branch_hit")).alias("state"),
        )
    )


def scope_and_own_states(df: DataFrame, keys: Sequence[str] = WAYPOINT) -> DataFrame:
    """``state`` of every (file, line) over all rows, and ``own_state`` over those with ``own``, NULL where there are none.

    Both come from one pass of the aggregates of ``line_coverage``.
    """
    own = F.col("own")
    per_branch = (
        explode_branches(df)
        .groupBy(*keys, "file_name", "line_number", "branch_index")
        .agg(
            F.max("contains_branch").alias("contains_branch"),
            F.sum("hits").alias("hits"),
            (F.sum("branch_hit") > 0).alias("is_branch_hit"),
            F.coalesce(F.max(own), F.lit(False)).alias("own"),
            F.max(F.when(own, F.col("contains_branch"))).alias("own_contains_branch"),
            F.sum(F.when(own, F.col("hits"))).alias("own_hits"),
            (F.sum(F.when(own, F.col("branch_hit"))) > 0).alias("own_is_branch_hit"),
        )
    )

    def state(prefix: str) -> Column:
        hit = F.col(f"{prefix}is_branch_hit")
        covered = F.count_if(F.col(f"{prefix}contains_branch") & hit)
        return L.classify_line_state(F.sum(f"{prefix}hits"), covered, F.min(hit))

    return per_branch.groupBy(*keys, "file_name", "line_number").agg(
        state("").alias("state"), F.when(F.max("own"), state("own_")).alias("own_state")
    )


def _count_state(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def summed_states(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line counts per state within the keys."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        *[_count_state(state).alias(state) for state in (L.COVERED, L.PARTIAL, L.UNCOVERED)],
    )


def total_coverage(lines: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Totals for every waypoint; a waypoint without lines has zeros."""
    summed = summed_states(lines, WAYPOINT)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "covered", "partial", "uncovered")]
    return (
        waypoints.select(*WAYPOINT)
        .join(summed, list(WAYPOINT), "left")
        .select(*WAYPOINT, *counts)
        .withColumn(
            "coverage_percentage", L.percentage(F.col("covered") + F.col("partial"), F.col("lines"))
        )
    )


def file_coverage(lines: DataFrame, keys: Sequence[str] = WAYPOINT, limit: int | None = None) -> DataFrame:
    """Sorted line numbers per state and percentage of every file.

    An array holds the distinct lines of one source file, so its size is that
    of the file, not of the data. With ``limit`` only the least covered files
    of each group are kept, and the arrays are built for those files alone.
    """
    if limit is not None:
        worst = least_covered_files(lines, limit, keys).select(*keys, "file_name")
        lines = lines.join(worst, [*keys, "file_name"], "left_semi")

    def numbers(state: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("line_number"))))

    hit = _count_state(L.COVERED) + _count_state(L.PARTIAL)
    return lines.groupBy(*keys, "file_name").agg(
        F.array_sort(F.collect_list("line_number")).alias("lines"),
        numbers(L.COVERED).alias("covered_lines"),
        numbers(L.PARTIAL).alias("partial_lines"),
        numbers(L.UNCOVERED).alias("uncovered_lines"),
        L.percentage_2dp(hit, F.count(F.lit(1))).alias("coverage_percentage"),
    )


def file_percentages(lines: DataFrame, keys: Sequence[str] = WAYPOINT) -> DataFrame:
    """Percentage of every file, without the line arrays."""
    return summed_states(lines, [*keys, "file_name"]).select(
        *keys,
        "file_name",
        L.percentage_2dp(F.col("covered") + F.col("partial"), F.col("lines")).alias("coverage_percentage"),
    )


def least_covered_files(lines: DataFrame, n: int, keys: Sequence[str] = WAYPOINT) -> DataFrame:
    """The ``n`` files with the lowest percentage per group; ties go by file name.

    ``row_number() <= n`` lets Spark cut every task's rows to n per group before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy("coverage_percentage", "file_name")
    return (
        file_percentages(lines, keys)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


TAG_KEYS = ("tag", "total_lines", "source_commit")


def tag_coverage(df: DataFrame, keys: Sequence[str] = WAYPOINT) -> DataFrame:
    """Totals per (tag, upload size, commit): two uploads of a tag with different sizes give two rows.

    ``df`` is the output of ``join_upload_lines`` with the columns of ``TAG_KEYS``.
    """
    group = [*keys, *TAG_KEYS]
    return summed_states(line_coverage(df, group), group).select(
        *keys,
        F.col("tag").alias("tag_name"),
        F.struct(
            F.col("tag").alias("name"),
            F.col("source_commit").alias("commit"),
            F.array("total_lines").alias("successfully_uploaded_lines"),
        ).alias("tag"),
        "lines",
        "covered",
        "partial",
        "uncovered",
        L.percentage_2dp(F.col("covered") + F.col("partial"), F.col("lines")).alias("coverage_percentage"),
    )


def order_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*WAYPOINT, "file_name", "line_number")


def order_tags(tags: DataFrame) -> DataFrame:
    return tags.orderBy(*WAYPOINT, "tag_name")
