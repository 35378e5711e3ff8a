"""Reports for all waypoints at once: coverage, files, tags, diff, comparison, pull-request summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgrain.functions import lines as L
from hitgrain.operators import coverage as C
from hitgrain.operators import history as H
from hitgrain.operators import scope as S
from hitgrain.operators.coverage import WAYPOINT

W = list(WAYPOINT)


def report_scope(
    waypoints: DataFrame, uploads: DataFrame, history: DataFrame, tag_settings: DataFrame
) -> DataFrame:
    """Own and carried-forward uploads of each waypoint.

    A carried tag is one the commit lacks and comes from another commit, so
    the two parts never overlap and need no distinct.
    """
    candidates = H.carryforward_candidates(waypoints, uploads, tag_settings)
    nearest = H.nearest_tag_commits(candidates, history, uploads)
    return S.scope_uploads(uploads, waypoints).unionByName(S.scope_carryforward(uploads, nearest))


def coverage_report(waypoints: DataFrame, scope: DataFrame, lines: DataFrame) -> DataFrame:
    """The numbers of a report in one row per waypoint; zeros when nothing is in scope.

    ``scope`` is the output of ``report_scope``, ``lines`` any typed lines; of ``stored_lines`` only the days in scope
    are read. All line totals come from one aggregate.
    """
    states = C.line_coverage(C.join_upload_lines(scope.select(*W, "upload_id", "ingest_date"), lines))
    return report_numbers(waypoints, scope, states)


def report_numbers(waypoints: DataFrame, scope: DataFrame, states: DataFrame) -> DataFrame:
    """``coverage_report`` from the line states of the scope."""
    totals = C.summed_states(states, WAYPOINT)
    own = F.count_if(F.col("source_commit") == F.col("commit_id"))
    sizes = scope.groupBy(*W).agg(own.alias("uploads"), F.sum("total_lines").alias("size"))
    rows = waypoints.select(*W).join(sizes, W, "left").join(totals, W, "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        *W,
        *[F.coalesce(c, zero).alias(c) for c in ("uploads", "size", "lines")],
        F.coalesce(F.col("covered") + F.col("partial"), zero).alias("at_least_partial"),
        F.coalesce("uncovered", zero).alias("uncovered"),
    ).withColumn("coverage_percentage", L.percentage(F.col("at_least_partial"), F.col("lines")))


def scoped_lines(scope: DataFrame, lines: DataFrame) -> DataFrame:
    return C.join_upload_lines(scope, lines)


def file_report(scope: DataFrame, lines: DataFrame) -> DataFrame:
    return C.file_coverage(C.line_coverage(C.join_upload_lines(scope.select(*W, "upload_id", "ingest_date"), lines)))


def tag_report(scope: DataFrame, lines: DataFrame) -> DataFrame:
    return C.tag_coverage(scoped_lines(scope, lines))


def diff_line_coverage(
    waypoints: DataFrame, uploads: DataFrame, lines: DataFrame, diff: DataFrame
) -> DataFrame:
    """Line states of the added lines with their ``diff_index``, from the commit's own uploads only."""
    own = S.scope_uploads(uploads, waypoints).select(*W, "upload_id", "ingest_date")
    return S.diff_line_states(C.join_upload_lines(own, lines), diff)


def scope_and_own_states(scope: DataFrame, lines: DataFrame) -> DataFrame:
    """Line states of each waypoint over its whole scope and over its own uploads, from one join with the lines."""
    own = (F.col("source_commit") == F.col("commit_id")).alias("own")
    return C.scope_and_own_states(C.join_upload_lines(scope.select(*W, "upload_id", "ingest_date", own), lines))


def own_diff_lines(states: DataFrame, diff: DataFrame) -> DataFrame:
    """The added lines that the commit's own uploads hold, with ``diff_index`` and ``state``, from ``scope_and_own_states``.

    ``diff`` has one row per (waypoint, file, line).
    """
    keys = [*W, "file_name", "line_number"]
    own = states.filter(F.col("own_state").isNotNull()).select(*keys, F.col("own_state").alias("state"))
    return own.join(diff.select(*keys, "diff_index"), keys)


def diff_totals(waypoints: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """Percentage and uncovered lines of the diff.

    The percentage is NULL when there is no diff, no upload or no line that
    could be covered; the count of uncovered lines is then 0.
    """
    totals = C.summed_states(diff_lines, WAYPOINT)
    return (
        waypoints.select(*W)
        .join(totals, W, "left")
        .select(
            *W,
            F.when(F.col("lines") > 0, L.percentage(F.col("covered") + F.col("partial"), F.col("lines"))).alias(
                "diff_coverage_percentage"
            ),
            F.coalesce("uncovered", F.lit(0)).alias("diff_uncovered_lines"),
        )
    )


def diff_coverage(waypoints: DataFrame, diff_lines: DataFrame) -> DataFrame:
    return diff_totals(waypoints, diff_lines).select(*W, "diff_coverage_percentage")


def diff_uncovered_lines(waypoints: DataFrame, diff_lines: DataFrame) -> DataFrame:
    return diff_totals(waypoints, diff_lines).select(*W, F.col("diff_uncovered_lines").alias("uncovered"))


def least_covered_diff_files(diff_lines: DataFrame, n: int = 10) -> DataFrame:
    return C.least_covered_files(diff_lines, n)


def coverage_comparison(reports: DataFrame, bases: DataFrame) -> DataFrame:
    """Head against base; the change is rounded after the difference of unrounded percentages.

    Heads whose base has no report are left out.
    """
    numbers = ("coverage_percentage", "uncovered", "size")
    base = reports.select(
        "project_id", F.col("commit_id").alias("base_commit"), *[F.col(c).alias(f"base_{c}") for c in numbers]
    )
    return (
        reports.join(bases.select(*W, "base_commit"), W)
        .join(base, ["project_id", "base_commit"])
        .select(
            *W,
            "base_commit",
            L.round_2dp(F.col("coverage_percentage") - F.col("base_coverage_percentage")).alias("coverage_change"),
            (F.col("uncovered") - F.col("base_uncovered")).alias("uncovered_lines_change"),
            (F.col("size") + F.col("base_size")).alias("size"),
        )
    )


def pull_request_summary(
    reports: DataFrame, comparison: DataFrame, diff: DataFrame, files: DataFrame
) -> DataFrame:
    """The numbers published about a commit in one row, its few impacted files as an array.

    ``diff`` is the output of ``diff_totals`` and ``files`` of ``least_covered_diff_files``. The commit's tags are
    the rows of ``pull_request_tags``.
    """
    change = F.col("coverage_change")
    verdict = F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("not change")
    file_arrays = files.groupBy(*W).agg(
        F.array_sort(F.collect_list(F.struct("rank", "file_name", "coverage_percentage"))).alias("impacted_files")
    )
    return (
        reports.join(comparison.select(*W, "base_commit", "coverage_change", "uncovered_lines_change"), W, "left")
        .join(diff, W, "left")
        .join(file_arrays, W, "left")
        .select(
            *W,
            "base_commit",
            "uploads",
            L.round_2dp(F.col("coverage_percentage")).alias("total_coverage"),
            "diff_coverage_percentage",
            "diff_uncovered_lines",
            "coverage_change",
            "uncovered_lines_change",
            verdict.alias("verdict"),
            "impacted_files",
        )
    )


def pull_request_tags(tags: DataFrame) -> DataFrame:
    """The tags published about a commit, one row each, from ``tag_report``."""
    return tags.select(
        *W,
        "tag_name",
        F.col("tag.commit").alias("tag_commit"),
        (F.col("tag.commit") != F.col("commit_id")).alias("carried_forward"),
        "lines",
        "covered",
        "partial",
        "uncovered",
        "coverage_percentage",
    )


def record_ref_coverage(existing: DataFrame | None, finalised: DataFrame) -> DataFrame:
    """Newest percentage per (repository, ref) over the old table and new results."""
    columns = ["repository_id", "ref", "coverage_percentage", "event_time"]
    rows = finalised.select(*columns)
    if existing is not None:
        rows = existing.select(*columns).unionByName(rows)
    newest = F.max_by(F.struct("coverage_percentage", "event_time"), "event_time")
    return rows.groupBy("repository_id", "ref").agg(newest.alias("newest")).select(
        "repository_id", "ref", "newest.coverage_percentage", "newest.event_time"
    )


def latest_ref_coverage(refs: DataFrame, wanted: DataFrame, default_ref: str = "main") -> DataFrame:
    """Look up (repository_id, ref); a request without a ref means the default one."""
    keys = wanted.select("repository_id", F.coalesce("ref", F.lit(default_ref)).alias("ref"))
    return refs.join(keys, ["repository_id", "ref"]).select("repository_id", "ref", "coverage_percentage")
