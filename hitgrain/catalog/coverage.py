"""Queries on line states: explode, classify, aggregate, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.catalog import Query
from hitgrain.catalog import sql as S
from hitgrain.functions import lines as L
from hitgrain.operators import coverage as C
from hitgrain.operators import scope, uploads
from hitgrain.operators.rows import metric_rollup
from hitgrain.sources import bind

W = list(C.WAYPOINT)


def text(column: str | Column) -> Column:
    """An array as text, so that results compare as plain values."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


def joined(spark: SparkSession, d: str, sizes: bool = False) -> DataFrame:
    """Lines of every waypoint's own uploads."""
    up = bind.uploads(spark, d, sizes=sizes)
    scoped = up.withColumn("source_commit", F.col("commit_id")).select(
        *W, "upload_id", "tag", "total_lines", "source_commit"
    )
    return C.join_upload_lines(scoped, bind.lines(spark, d))


def states(spark: SparkSession, d: str) -> DataFrame:
    return C.line_coverage(joined(spark, d))


def diff_states(spark: SparkSession, d: str) -> DataFrame:
    """Line states of every waypoint's diff."""
    return scope.diff_line_states(joined(spark, d), bind.diff(spark, d))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the stored key/value metadata."""
    rows = bind.lines(spark, d)
    return rows.select(
        "upload_id",
        "file_name",
        "line_number",
        "type",
        L.encode_metadata(
            F.col("type"), F.col("line_number"), F.col("hits"), F.col("branch_json"), F.concat(F.lit("m"), "line_number")
        ).alias("metadata"),
    )


KEY = ["upload_id", "file_name", "line_number", "type"]
FLAGS = ["contains_method", "contains_branch", "contains_statement"]
STATE_COLUMNS = [*W, "file_name", "line_number", *FLAGS, "total_branches", "covered_branches", "state"]


def q_file_coverage(spark: SparkSession, d: str) -> DataFrame:
    arrays = ["lines", "covered_lines", "partial_lines", "uncovered_lines"]
    return C.file_coverage(states(spark, d)).select(
        *W, "file_name", *[text(c).alias(c) for c in arrays], "coverage_percentage"
    )


def q_tag_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.tag_coverage(joined(spark, d, sizes=True)).select(
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


def q_upload_summary(spark: SparkSession, d: str) -> DataFrame:
    up = bind.uploads(spark, d, sizes=True)
    return uploads.upload_summary(up, up.select(*W).distinct())


def q_tag_availability(spark: SparkSession, d: str) -> DataFrame:
    up = bind.uploads(spark, d, bind.SPARSE, sizes=True)
    return uploads.tag_availability(up, up.select(*W).distinct())


def q_metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = bind.uploads(spark, d, sizes=True).select(
        F.lit("github").alias("provider"),
        F.concat(F.lit("owner-"), F.col("tag")).alias("owner"),
        F.col("project_id").alias("repository"),
        "total_lines",
    )
    return metric_rollup(
        rows, "total_lines", [("provider", "owner"), ("provider", "owner", "repository")]
    ).select("provider", "owner", "repository", F.col("grouping_id").cast("int").alias("grouping_id"), "value")


QUERIES: dict[str, Query] = {
    "flag_line_types": lambda s, d: bind.lines(s, d).select(*KEY, *L.flag_line_types(F.col("type"))),
    "encode_metadata": lambda s, d: metadata(s, d).select(*KEY, F.to_json("metadata").alias("metadata")),
    "extract_line_hits": lambda s, d: metadata(s, d).select(
        *KEY, L.extract_line_hits(F.col("metadata")).alias("hits")
    ),
    "extract_branch_hits": lambda s, d: metadata(s, d).select(
        *KEY, text(L.extract_branch_hits(F.col("metadata"))).alias("branch_hits")
    ),
    "join_upload_lines": lambda s, d: joined(s, d).select(
        *W, "upload_id", "tag", "file_name", "line_number", *FLAGS, "hits", text("branch_hits").alias("branch_hits")
    ),
    "explode_branches": lambda s, d: C.explode_branches(joined(s, d)).select(
        *W, "upload_id", "file_name", "line_number", *FLAGS, "hits", "branch_index", "branch_hit"
    ),
    "branching_lines": lambda s, d: C.branching_lines(joined(s, d)).select(
        *W, "file_name", "line_number", "branch_index", *FLAGS, "hits", "is_branch_hit"
    ),
    "line_coverage": lambda s, d: states(s, d).select(*STATE_COLUMNS),
    "order_lines": lambda s, d: C.order_lines(states(s, d)).select(*W, "file_name", "line_number", "state"),
    "classify_line_state": lambda s, d: states(s, d).select(
        *W, "file_name", "line_number", *FLAGS, "total_branches", "covered_branches", "state"
    ),
    "line_type_set": lambda s, d: states(s, d).select(
        *W, "file_name", "line_number", text(L.line_type_set(*[F.col(f) for f in FLAGS])).alias("types")
    ),
    "total_coverage": lambda s, d: C.total_coverage(states(s, d), bind.waypoints(s, d)),
    "file_coverage": q_file_coverage,
    "least_covered_files": lambda s, d: C.least_covered_files(states(s, d), 10).select(
        *W, "file_name", "coverage_percentage", "rank"
    ),
    "ordered_array_aggregation": lambda s, d: C.file_coverage(states(s, d)).select(
        *W, "file_name", *[text(c).alias(c) for c in ("lines", "covered_lines", "partial_lines", "uncovered_lines")]
    ),
    "tag_coverage": q_tag_coverage,
    "order_tags": lambda s, d: C.order_tags(C.tag_coverage(joined(s, d, sizes=True))).select(
        *W, "tag_name", "lines", "covered"
    ),
    "upload_summary": q_upload_summary,
    "tag_availability": q_tag_availability,
    "uploaded_tags": lambda s, d: uploads.uploaded_tags(bind.uploads(s, d)),
    "latest_upload": lambda s, d: uploads.latest_upload(bind.uploads(s, d), bind.waypoints(s, d)).select(
        *W, uploads.time_text("latest_ingest_time").alias("latest_ingest_time")
    ),
    "metric_rollup": q_metric_rollup,
}

_KEY = "upload_id, file_name, line_number, type"
_FLAGS = "contains_method, contains_branch, contains_statement"
_HIT = "count(*) filter (where state in ('covered', 'partial'))"
_FILE_PERCENT = f"""select project_id, commit_id, file_name, {S.percent_2dp(_HIT, 'count(*)')} as coverage_percentage
  from line_state group by project_id, commit_id, file_name"""
_RANKED = f"""select *, row_number() over (partition by project_id, commit_id order by coverage_percentage, file_name) as rank
  from ({_FILE_PERCENT})"""


def _numbers(state: str) -> str:
    return f"coalesce(string_agg(cast(line_number as varchar), ',' order by line_number) filter (where state = '{state}'), '')"


_PAIR = """concat('{"key":"', k, '","value":"', replace(v, '"', chr(92) || '"'), '"}')"""


def _entry(key: str, value: str) -> str:
    return _PAIR.replace("k,", f"'{key}',").replace("(v,", f"({value},")


_TAG_KEYS = "project_id, commit_id, tag, total_lines, source_commit"
_TAG_TOTALS = f"""select project_id, commit_id, tag as tag_name, source_commit as tag_commit,
    cast(total_lines as varchar) as uploaded_lines, {S.COUNTS}, {S.percent_2dp(_HIT, 'count(*)')} as coverage_percentage
  from ({S.states('unnested', _TAG_KEYS)}) group by {_TAG_KEYS}"""
_TIME = "strftime(ingest_time, '%Y-%m-%d %H:%M:%S')"

ORACLES: dict[str, str] = {
    "flag_line_types": S.query(f"select {_KEY}, {_FLAGS} from line_cov"),
    "encode_metadata": S.query(
        f"""select {_KEY}, concat('[', {_entry('type', 'type')}, ',', {_entry('lineNumber', 'cast(line_number as varchar)')}, ',',
        {_entry('lineHits', 'cast(hits as varchar)')},
        case when type = 'BRANCH' then concat(',', {_entry('branchHits', 'branch_json')}) else '' end,
        case when type = 'METHOD' then concat(',', {_entry('name', "concat('m', cast(line_number as varchar))")}) else '' end,
        ']') as metadata from line_cov"""
    ),
    "extract_line_hits": S.query(f"select {_KEY}, hits from line_cov"),
    "extract_branch_hits": S.query(
        f"select {_KEY}, array_to_string(branch_hits, ',') as branch_hits from line_cov"
    ),
    "join_upload_lines": S.query(
        f"""select project_id, commit_id, upload_id, tag, file_name, line_number, {_FLAGS}, hits,
        array_to_string(branch_hits, ',') as branch_hits from unnested"""
    ),
    "explode_branches": S.query(
        f"""select project_id, commit_id, upload_id, file_name, line_number, {_FLAGS}, hits, branch_index, branch_hit
        from ({S.exploded('unnested')})"""
    ),
    "branching_lines": S.query(S.branching("unnested", S.WAYPOINT)),
    "line_coverage": S.query(
        f"""select project_id, commit_id, file_name, line_number, {_FLAGS}, total_branches, covered_branches, state
        from line_state"""
    ),
    "order_lines": S.query(
        "select project_id, commit_id, file_name, line_number, state from line_state order by 1, 2, 3, 4"
    ),
    "classify_line_state": S.query(
        f"select project_id, commit_id, file_name, line_number, {_FLAGS}, total_branches, covered_branches, state from line_state"
    ),
    "line_type_set": S.query(
        """select project_id, commit_id, file_name, line_number,
        concat_ws(',', case when contains_method then 'METHOD' end, case when contains_branch then 'BRANCH' end,
          case when contains_statement then 'STATEMENT' end) as types from line_state"""
    ),
    "total_coverage": S.query(
        f"""select w.project_id, w.commit_id, lines, covered, partial, uncovered, {S.PERCENT} as coverage_percentage
        from (select w.project_id, w.commit_id, count(state) as lines, count(*) filter (where state = 'covered') as covered,
          count(*) filter (where state = 'partial') as partial, count(*) filter (where state = 'uncovered') as uncovered
          from waypoint w left join line_state t on t.project_id = w.project_id and t.commit_id = w.commit_id
          group by w.project_id, w.commit_id) w"""
    ),
    "file_coverage": S.query(
        f"""select project_id, commit_id, file_name, string_agg(cast(line_number as varchar), ',' order by line_number) as lines,
        {_numbers('covered')} as covered_lines, {_numbers('partial')} as partial_lines,
        {_numbers('uncovered')} as uncovered_lines, {S.percent_2dp(_HIT, 'count(*)')} as coverage_percentage
        from line_state group by project_id, commit_id, file_name"""
    ),
    "least_covered_files": S.query(
        f"""select project_id, commit_id, file_name, coverage_percentage, cast(rank as integer) as rank
        from ({_RANKED}) where rank <= 10"""
    ),
    "ordered_array_aggregation": S.query(
        f"""select project_id, commit_id, file_name, string_agg(cast(line_number as varchar), ',' order by line_number) as lines,
          {_numbers('covered')} as covered_lines, {_numbers('partial')} as partial_lines, {_numbers('uncovered')} as uncovered_lines
        from line_state group by project_id, commit_id, file_name"""
    ),
    "tag_coverage": S.query(_TAG_TOTALS),
    "order_tags": S.query(
        f"select project_id, commit_id, tag_name, lines, covered from ({_TAG_TOTALS}) order by 1, 2, 3"
    ),
    "upload_summary": S.query(
        f"""select project_id, commit_id, upload_id, {_TIME} as ingest_time, tag as tag_name,
        total_lines as successfully_uploaded_lines from upload"""
    ),
    "tag_availability": S.query(
        f"""select project_id, commit_id, tag as tag_name, upload_id, total_lines as successfully_uploaded_lines,
        {_TIME} as ingest_time from upload_sparse"""
    ),
    "uploaded_tags": S.query("select distinct project_id, tag as tag_name from upload"),
    "latest_upload": S.query(
        """select project_id, commit_id, strftime(max(ingest_time), '%Y-%m-%d %H:%M:%S') as latest_ingest_time
        from upload group by project_id, commit_id"""
    ),
    "metric_rollup": S.query(
        """select 'github' as provider, concat('owner-', tag) as owner, project_id as repository,
          cast(grouping(project_id) as integer) as grouping_id, cast(sum(total_lines) as bigint) as value
        from upload group by grouping sets ((tag), (tag, project_id))"""
    ),
}
