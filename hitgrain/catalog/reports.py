"""Queries on whole reports, line comments and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.catalog import Query
from hitgrain.catalog import sql as S
from hitgrain.catalog.coverage import FLAGS, W, diff_states, states, text
from hitgrain.catalog.scoping import commits, sparse, whole_scope
from hitgrain.functions import lines as L
from hitgrain.functions.events import message_group_hash
from hitgrain.operators import comments as K
from hitgrain.operators import history as H
from hitgrain.operators import messages as M
from hitgrain.operators import sinks, uploads
from hitgrain.plans import reports as R
from hitgrain.plans.reports import report_scope
from hitgrain.session import stage_table, work_dir
from hitgrain.sources import bind
from hitgrain.sources.refs import stored_refs, upsert_refs
from hitgrain.sources.stored import stored_lines, stored_uploads


def report(spark: SparkSession, d: str) -> DataFrame:
    scope = stage_table(whole_scope(spark, d, sizes=True), "scope")
    return R.coverage_report(commits(spark, d), scope, bind.lines(spark, d))


def store_rows(spark: SparkSession, d: str, root: str) -> None:
    """All lines and uploads in their stored form, through the sinks."""
    up = sparse(spark, d, sizes=True)
    metadata = L.encode_metadata(F.col("type"), F.col("line_number"), F.col("hits"), F.col("branch_json"), F.lit("m"))
    rows = bind.lines(spark, d).select("upload_id", "file_name", "line_number", "type", "hits", "branch_json")
    stored = ["upload_id", "file_name", "line_number", "type", metadata.alias("metadata"), "ingest_time", "ingest_date"]
    # In months, which keeps the folders of seven years few.
    month = F.date_trunc("month", F.col("ingest_time").cast("timestamp")).cast("timestamp_ntz")
    up = up.withColumn("ingest_time", month)
    dated = rows.join(up.select("upload_id", "ingest_time"), "upload_id")
    sinks.write_ingest(dated, up.drop("commit_no"), f"{root}/lines", f"{root}/uploads", lambda lines: lines.select(*stored))


def q_stored_report(spark: SparkSession, d: str) -> DataFrame:
    """The report from what the sinks stored, by days in scope."""
    root = work_dir(spark, "stored")
    store_rows(spark, d, root)
    up = stored_uploads(spark, f"{root}/uploads")
    scope = stage_table(report_scope(commits(spark, d), up, bind.history(spark, d), bind.tag_settings(spark, d)), "scope")
    return R.coverage_report(commits(spark, d), scope, stored_lines(spark, f"{root}/lines"))


def bases(spark: SparkSession, d: str) -> DataFrame:
    return H.base_commit(bind.finalised_events(spark, d), bind.history(spark, d))


def comparison(spark: SparkSession, d: str) -> DataFrame:
    reports = stage_table(report(spark, d), "reports")
    return R.coverage_comparison(reports, bases(spark, d))


def sparse_diff_states(spark: SparkSession, d: str) -> DataFrame:
    return R.diff_line_coverage(
        commits(spark, d), sparse(spark, d), bind.lines(spark, d), bind.diff(spark, d, bind.SPARSE)
    )


def q_file_report(spark: SparkSession, d: str) -> DataFrame:
    arrays = ["lines", "covered_lines", "partial_lines", "uncovered_lines"]
    return R.file_report(whole_scope(spark, d), bind.lines(spark, d)).select(
        *W, "file_name", *[text(c).alias(c) for c in arrays], "coverage_percentage"
    )


def q_tag_report(spark: SparkSession, d: str) -> DataFrame:
    return R.tag_report(whole_scope(spark, d, sizes=True), bind.lines(spark, d)).select(
        *W,
        "tag_name",
        F.col("tag.commit").alias("tag_commit"),
        text("tag.successfully_uploaded_lines").alias("uploaded_lines"),
        "lines",
        "covered",
        "partial",
        "uncovered",
        "coverage_percentage",
    )


def q_pull_request_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = bind.lines(spark, d)
    scope = stage_table(whole_scope(spark, d, sizes=True), "scope")
    found = stage_table(R.scope_and_own_states(scope, lines), "states")
    diff_lines = stage_table(R.own_diff_lines(found, bind.diff(spark, d, bind.SPARSE)), "diff-lines")
    reports = stage_table(R.report_numbers(commits(spark, d), scope, found), "reports")
    summary = R.pull_request_summary(
        reports,
        R.coverage_comparison(reports, bases(spark, d)),
        R.diff_totals(commits(spark, d), diff_lines),
        R.least_covered_diff_files(diff_lines),
    )
    return summary.select(
        *W,
        "base_commit",
        "uploads",
        "total_coverage",
        "diff_coverage_percentage",
        "diff_uncovered_lines",
        "coverage_change",
        "uncovered_lines_change",
        "verdict",
        text(F.transform("impacted_files", lambda f: f["file_name"])).alias("impacted_files"),
    )


def q_pull_request_tags(spark: SparkSession, d: str) -> DataFrame:
    return R.pull_request_tags(R.tag_report(whole_scope(spark, d, sizes=True), bind.lines(spark, d)))


def ref_results(spark: SparkSession, d: str) -> DataFrame:
    """Total coverage of each finalised commit with its ref; the commit number orders them in time."""
    events = bind.finalised_events(spark, d, bind.DENSE)
    numbers = bind.waypoints(spark, d)
    totals = R.C.total_coverage(states(spark, d), numbers)
    return (
        events.select(*W, "ref")
        .join(numbers, W)
        .join(totals, W)
        .select(F.col("project_id").alias("repository_id"), "ref", "coverage_percentage", F.col("commit_no").alias("event_time"))
    )


def q_sink_ref_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Results of the earlier commits, then those of the later ones, then the earlier ones again."""
    root = work_dir(spark, "ref-metadata")
    results = stage_table(ref_results(spark, d), "results")
    for part in ("event_time < 10", "event_time >= 10", "event_time < 10"):
        upsert_refs(root, results.filter(part))
    return stored_refs(spark, root, time=results.schema["event_time"].dataType.simpleString()).drop("bucket")


def q_latest_ref_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The latest coverage of every project's feature-1 and of its default ref."""
    refs = R.record_ref_coverage(None, ref_results(spark, d))
    projects = bind.comment_settings(spark, d).select("repository_id")
    wanted = projects.withColumn("ref", F.lit("feature-1")).unionByName(
        projects.withColumn("ref", F.lit(None).cast("string"))
    )
    return R.latest_ref_coverage(refs, wanted, default_ref="feature-2")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Each event is a queued collection of two messages for its user's group."""
    events = bind.table(spark, d, "events")

    def message(number: int) -> Column:
        return F.struct(
            (F.floor(F.col("value") * 10) + number * (F.col("event_id") % 5)).alias("valid_until"),
            F.concat_ws("-", F.col("event_type"), F.col("event_id").cast("string"), F.lit(str(number))).alias("payload"),
        )

    return events.select(
        message_group_hash(
            F.lit("github"),
            F.concat(F.lit("o"), (F.col("user_id") % 10).cast("string")),
            F.concat(F.lit("r"), F.col("user_id").cast("string")),
            F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50),
            F.concat(F.lit("c"), F.col("user_id").cast("string")),
        ).alias("message_group"),
        F.col("event_id").alias("seq"),
        F.array(message(0), message(1)).alias("messages"),
    )


def q_line_comments(spark: SparkSession, d: str) -> DataFrame:
    lines = stage_table(diff_states(spark, d), "diff-lines")
    return K.line_comments(
        K.missing_coverage_blocks(lines),
        K.partial_branch_comments(lines),
        bind.comment_settings(spark, d),
    )


QUERIES: dict[str, Query] = {
    "report_size": lambda s, d: uploads.report_size(whole_scope(s, d, sizes=True), commits(s, d)),
    "coverage_report": report,
    "stored_coverage_report": q_stored_report,
    "file_report": q_file_report,
    "tag_report": q_tag_report,
    "diff_coverage": lambda s, d: R.diff_coverage(commits(s, d), sparse_diff_states(s, d)),
    "diff_uncovered_lines": lambda s, d: R.diff_uncovered_lines(commits(s, d), sparse_diff_states(s, d)),
    "least_covered_diff_files": lambda s, d: R.least_covered_diff_files(diff_states(s, d)).select(
        *W, "file_name", "coverage_percentage", "rank"
    ),
    "diff_line_coverage": lambda s, d: diff_states(s, d).select(
        *W, "file_name", "line_number", *FLAGS, "total_branches", "covered_branches", "state"
    ),
    "coverage_comparison": comparison,
    "pull_request_summary": q_pull_request_summary,
    "pull_request_tags": q_pull_request_tags,
    "sink_ref_metadata": q_sink_ref_metadata,
    "latest_ref_coverage": q_latest_ref_coverage,
    "missing_coverage_blocks": lambda s, d: K.missing_coverage_blocks(diff_states(s, d)),
    "partial_branch_comments": lambda s, d: K.partial_branch_comments(diff_states(s, d)),
    "line_comments": q_line_comments,
    "message_group_hash": lambda s, d: messages(s, d).select("seq", "message_group"),
    "latest_message_per_group": lambda s, d: M.latest_message_per_group(messages(s, d)),
}

_HIT = "count(*) filter (where state in ('covered', 'partial'))"
_TAG_KEYS = "project_id, commit_id, tag, total_lines, source_commit"


def _numbers(state: str) -> str:
    return f"coalesce(string_agg(cast(line_number as varchar), ',' order by line_number) filter (where state = '{state}'), '')"


S.BLOCKS["scope_size"] = """
  select project_id, commit_id, count(*) filter (where source_commit = commit_id) as uploads,
    cast(sum(total_lines) as bigint) as size
  from scope_sparse group by project_id, commit_id"""
S.BLOCKS["report"] = f"""
  select w.project_id, w.commit_id, coalesce(z.uploads, 0) as uploads, coalesce(z.size, 0) as size,
    coalesce(t.lines, 0) as lines, coalesce(t.covered + t.partial, 0) as at_least_partial,
    coalesce(t.uncovered, 0) as uncovered,
    coalesce(t.covered + t.partial, 0) / cast(case when coalesce(t.lines, 0) = 0 then 1 else t.lines end as double) * 100.0
      as coverage_percentage
  from waypoint_sparse w
  left join scope_size z on z.project_id = w.project_id and z.commit_id = w.commit_id
  left join (select project_id, commit_id, {S.COUNTS} from scoped_state group by project_id, commit_id) t
    on t.project_id = w.project_id and t.commit_id = w.commit_id"""
S.BLOCKS["comparison"] = f"""
  select r.project_id, r.commit_id, b.base_commit,
    {S.round_2dp('(r.coverage_percentage - o.coverage_percentage)')} as coverage_change,
    r.uncovered - o.uncovered as uncovered_lines_change, r.size + o.size as size
  from report r join base_choice b on b.project_id = r.project_id and b.commit_id = r.commit_id
  join report o on o.project_id = r.project_id and o.commit_id = b.base_commit"""
S.BLOCKS["diff_total"] = f"""
  select w.project_id, w.commit_id,
    case when lines > 0 then (covered + partial) / cast(lines as double) * 100.0 end as diff_coverage_percentage,
    coalesce(uncovered, 0) as diff_uncovered_lines
  from waypoint_sparse w
  left join (select project_id, commit_id, {S.COUNTS} from diff_state_sparse group by project_id, commit_id) t
    on t.project_id = w.project_id and t.commit_id = w.commit_id"""
S.BLOCKS["tag_total"] = f"""
  select project_id, commit_id, tag as tag_name, source_commit as tag_commit,
    cast(total_lines as varchar) as uploaded_lines, {S.COUNTS}, {S.percent_2dp(_HIT, 'count(*)')} as coverage_percentage
  from ({S.states('scoped_lines', _TAG_KEYS)}) group by {_TAG_KEYS}"""


def _worst(states: str) -> str:
    return f"""(select * from (
      select *, row_number() over (partition by project_id, commit_id order by coverage_percentage, file_name) as rank
      from (select project_id, commit_id, file_name, {S.percent_2dp(_HIT, 'count(*)')} as coverage_percentage
            from {states} group by project_id, commit_id, file_name)) where rank <= 10)"""


S.BLOCKS["block"] = """
  select project_id, commit_id, file_name, arg_min(contains_method, line_number) filter (where startable) as starts_on_method,
    min(line_number) filter (where startable) as start_line, max(line_number) as end_line
  from (
    select *, sum(cast(breaks as integer)) over (partition by project_id, commit_id, file_name order by line_number) as segment
    from (
      select s.*, not s.contains_branch and s.state <> 'covered' as startable,
        s.contains_method or s.state = 'covered' or not coalesce(
          d.diff_index - lag(d.diff_index) over (partition by s.project_id, s.commit_id, s.file_name order by s.line_number)
          = s.line_number - lag(s.line_number) over (partition by s.project_id, s.commit_id, s.file_name order by s.line_number),
          false) as breaks
      from diff_state s left join diff d on d.project_id = s.project_id and d.commit_id = s.commit_id
        and d.file_name = s.file_name and d.line_number = s.line_number))
  group by project_id, commit_id, file_name, segment
  having count(*) filter (where startable) > 0"""
S.BLOCKS["partial_branch"] = """
  select project_id, commit_id, file_name, line_number, total_branches, covered_branches from diff_state
  where contains_branch and state <> 'covered' and covered_branches <> total_branches"""
S.BLOCKS["message"] = """
  select md5(concat('github', 'o', cast(user_id % 10 as varchar), 'r', cast(user_id as varchar),
      case when event_id % 3 = 0 then cast(event_id % 50 as varchar) else concat('c', cast(user_id as varchar)) end)) as message_group,
    event_id as seq, event_type, cast(floor(value * 10) as bigint) as v0, cast(floor(value * 10) as bigint) + event_id % 5 as v1
  from events"""
_REF_ROWS = f"""
  select e.project_id as repository_id, e.ref, w.commit_no as event_time,
    coalesce(covered + partial, 0) / cast(case when coalesce(lines, 0) = 0 then 1 else lines end as double) * 100.0
      as coverage_percentage
  from finalised_event_dense e
  join waypoint w on w.project_id = e.project_id and w.commit_id = e.commit_id
  left join (select project_id, commit_id, {S.COUNTS} from line_state group by project_id, commit_id) t
    on t.project_id = e.project_id and t.commit_id = e.commit_id"""
S.BLOCKS["ref_row"] = _REF_ROWS
S.BLOCKS["ref_latest"] = """
  select repository_id, ref, arg_max(coverage_percentage, event_time) as coverage_percentage, max(event_time) as event_time
  from ref_row group by repository_id, ref"""

ORACLES: dict[str, str] = {
    "report_size": S.query(
        """select w.project_id, w.commit_id, coalesce(z.size, 0) as size from waypoint_sparse w
        left join scope_size z on z.project_id = w.project_id and z.commit_id = w.commit_id"""
    ),
    "coverage_report": S.query(
        """select project_id, commit_id, uploads, size, lines, at_least_partial, uncovered, coverage_percentage from report"""
    ),
    "stored_coverage_report": S.query(
        """select project_id, commit_id, uploads, size, lines, at_least_partial, uncovered, coverage_percentage from report"""
    ),
    "file_report": S.query(
        f"""select project_id, commit_id, file_name, string_agg(cast(line_number as varchar), ',' order by line_number) as lines,
        {_numbers('covered')} as covered_lines, {_numbers('partial')} as partial_lines,
        {_numbers('uncovered')} as uncovered_lines, {S.percent_2dp(_HIT, 'count(*)')} as coverage_percentage
        from scoped_state group by project_id, commit_id, file_name"""
    ),
    "tag_report": S.query(
        """select project_id, commit_id, tag_name, tag_commit, uploaded_lines, lines, covered, partial, uncovered,
        coverage_percentage from tag_total"""
    ),
    "diff_coverage": S.query("select project_id, commit_id, diff_coverage_percentage from diff_total"),
    "diff_uncovered_lines": S.query("select project_id, commit_id, diff_uncovered_lines as uncovered from diff_total"),
    "least_covered_diff_files": S.query(
        f"select project_id, commit_id, file_name, coverage_percentage, cast(rank as integer) as rank from {_worst('diff_state')}"
    ),
    "diff_line_coverage": S.query(
        """select project_id, commit_id, file_name, line_number, contains_method, contains_branch, contains_statement,
        total_branches, covered_branches, state from diff_state"""
    ),
    "coverage_comparison": S.query(
        "select project_id, commit_id, base_commit, coverage_change, uncovered_lines_change, size from comparison"
    ),
    "pull_request_summary": S.query(
        f"""select r.project_id, r.commit_id, c.base_commit, r.uploads,
          {S.round_2dp('r.coverage_percentage')} as total_coverage, d.diff_coverage_percentage, d.diff_uncovered_lines,
          c.coverage_change, c.uncovered_lines_change,
          case when c.coverage_change > 0 then 'increase' when c.coverage_change < 0 then 'decrease' else 'not change' end as verdict,
          f.impacted_files
        from report r
        left join comparison c on c.project_id = r.project_id and c.commit_id = r.commit_id
        left join diff_total d on d.project_id = r.project_id and d.commit_id = r.commit_id
        left join (select project_id, commit_id, string_agg(file_name, ',' order by rank) as impacted_files
                   from {_worst('diff_state_sparse')} group by project_id, commit_id) f
          on f.project_id = r.project_id and f.commit_id = r.commit_id"""
    ),
    "pull_request_tags": S.query(
        """select project_id, commit_id, tag_name, tag_commit, tag_commit <> commit_id as carried_forward, lines, covered,
        partial, uncovered, coverage_percentage from tag_total"""
    ),
    "sink_ref_metadata": S.query("select repository_id, ref, coverage_percentage, event_time from ref_latest"),
    "latest_ref_coverage": S.query(
        "select repository_id, ref, coverage_percentage from ref_latest where ref in ('feature-1', 'feature-2')"
    ),
    "missing_coverage_blocks": S.query(
        "select project_id, commit_id, file_name, starts_on_method, start_line, end_line from block"
    ),
    "partial_branch_comments": S.query(
        "select project_id, commit_id, file_name, line_number, total_branches, covered_branches from partial_branch"
    ),
    "line_comments": S.query(
        """select project_id, commit_id, file_name, line_number as start_line, line_number as end_line, 0 as position,
          'PARTIAL_BRANCH_LINE_COMMENT' as comment_type, false as starts_on_method, total_branches, covered_branches
        from partial_branch where project_id <> 'p2'
        union all
        select project_id, commit_id, file_name, start_line, end_line, 1, 'MISSING_COVERAGE_LINE_COMMENT',
          starts_on_method, null, null from block where project_id <> 'p2'"""
    ),
    "message_group_hash": S.query("select seq, message_group from message"),
    "latest_message_per_group": S.query(
        """select message_group, cast(n as integer) as position, case when n = 0 then v0 else v1 end as valid_until,
          concat(event_type, '-', cast(seq as varchar), '-', cast(n as varchar)) as payload
        from (select *, row_number() over (partition by message_group order by greatest(v0, v1) desc, seq) as r from message)
        cross join (select unnest([0, 1]) as n) where r = 1"""
    ),
}
