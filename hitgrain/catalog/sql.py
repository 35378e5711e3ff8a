"""Building blocks of the SQL side: the bound tables and line states as common table expressions."""

from __future__ import annotations

import re

# Every block may name the blocks above it.
BLOCKS: dict[str, str] = {
    "upload_counts": "select l_orderkey, count(*) as n from lineitem group by l_orderkey",
}


def _upload(modulus: int) -> str:
    return f"""
  select cast(o_orderkey as varchar) as upload_id, concat('p', cast(o_custkey % 5 as varchar)) as project_id,
    concat('c', lpad(cast(o_orderkey % {modulus} as varchar), 4, '0')) as commit_id,
    cast(o_orderkey % {modulus} as integer) as commit_no, replace(o_orderpriority, ' ', '_') as tag,
    o_orderdate as ingest_time, cast(coalesce(n, 0) as bigint) as total_lines
  from orders left join upload_counts on l_orderkey = o_orderkey"""


BLOCKS["upload"] = _upload(20)
BLOCKS["upload_sparse"] = _upload(1000)
BLOCKS["waypoint"] = "select distinct project_id, commit_id, commit_no from upload"
BLOCKS["waypoint_sparse"] = "select distinct project_id, commit_id, commit_no from upload_sparse"
BLOCKS["line_cov"] = """
  select upload_id, file_name, line_number, type, hits, in_diff,
    type = 'METHOD' as contains_method, type = 'BRANCH' as contains_branch, type = 'STATEMENT' as contains_statement,
    case when type <> 'BRANCH' then null when is_object then '{"0":1,"3":2}'
         else concat('[', cast(b0 as varchar), ',', cast(b1 as varchar), ']') end as branch_json,
    case when type = 'BRANCH' and not is_object then [b0, b1] else cast([] as bigint[]) end as branch_hits
  from (
    select cast(l_orderkey as varchar) as upload_id, concat('src/f', cast(l_partkey % 20 as varchar), '.py') as file_name,
      cast(1 + (l_partkey * 7 + l_suppkey) % 40 as integer) as line_number,
      case l_returnflag when 'A' then 'BRANCH' when 'N' then 'STATEMENT' else 'METHOD' end as type,
      cast(greatest(cast(l_quantity as integer) - 25, 0) as bigint) as hits,
      l_linenumber = 7 as is_object, l_linestatus = 'F' as in_diff,
      cast(greatest(cast(round(l_discount * 100) as bigint) - 3, 0) as bigint) as b0,
      cast(greatest(cast(round(l_tax * 100) as bigint) - 2, 0) as bigint) as b1
    from lineitem)"""
BLOCKS["lane"] = """
  select project_id, commit_no, commit_no % 10 >= 7 as feature,
    max(case when commit_no % 10 < 7 then commit_no end) over earlier as main_before,
    max(case when commit_no % 10 >= 7 then commit_no end) over earlier as feature_before
  from waypoint_sparse
  window earlier as (partition by project_id order by commit_no rows between unbounded preceding and 1 preceding)"""
BLOCKS["edge"] = """
  select project_id, commit_no as child,
    case when feature and feature_before // 10 = commit_no // 10 then feature_before else main_before end as parent
  from lane
  union
  select project_id, commit_no, feature_before from lane
  where not feature and feature_before > coalesce(main_before, -1) and feature_before // 10 % 2 = 0"""
BLOCKS["reach"] = """
  select project_id, child as head, parent as ancestor from edge where parent is not null
  union
  select reach.project_id, reach.head, edge.parent
  from reach join edge on edge.project_id = reach.project_id and edge.child = reach.ancestor
  where edge.parent is not null"""
BLOCKS["history"] = """
  select project_id, concat('c', lpad(cast(head as varchar), 4, '0')) as head,
    concat('c', lpad(cast(ancestor as varchar), 4, '0')) as ancestor, head - ancestor as position,
    case when ancestor % 4 <> 0 then ancestor % 2 = 0 end as merged,
    case when ancestor % 10 >= 7 then concat('feature-', cast(ancestor % 3 as varchar)) end as ref
  from reach"""


def _diff(uploads: str) -> str:
    return f"""
  select project_id, commit_id, file_name, line_number,
    cast(row_number() over (partition by project_id, commit_id, file_name order by line_number) - 1 as integer) as diff_index
  from (select distinct u.project_id, u.commit_id, l.file_name, l.line_number
        from {uploads} u join line_cov l on l.upload_id = u.upload_id where l.in_diff)"""


BLOCKS["diff"] = _diff("upload")
BLOCKS["diff_sparse"] = _diff("upload_sparse")


def _finalised(waypoints: str) -> str:
    return f"""
  select project_id, commit_id, concat('feature-', cast(commit_no % 3 as varchar)) as ref,
    case when commit_no % 4 <> 0 then 'main' end as base_ref,
    case when commit_no % 3 <> 0 then concat('c', lpad(cast(greatest(commit_no - 5, 0) as varchar), 4, '0')) end as base_commit,
    case when commit_no % 5 <> 0 then cast(commit_no as bigint) end as pull_request,
    case when commit_no > 0 and commit_no % 7 <> 0
         then concat('c', lpad(cast(commit_no - 1 as varchar), 4, '0')) end as first_parent
  from {waypoints}"""


BLOCKS["finalised_event"] = _finalised("waypoint_sparse")
BLOCKS["finalised_event_dense"] = _finalised("waypoint")
BLOCKS["projects"] = "select distinct concat('p', cast(o_custkey % 5 as varchar)) as repository_id from orders"
BLOCKS["tag_settings"] = """
  select repository_id, cast(null as varchar) as tag, repository_id <> 'p3' as carryforward from projects
  union all
  select repository_id, case when repository_id = 'p1' then '5-LOW' else '1-URGENT' end, repository_id = 'p3'
  from projects where repository_id in ('p1', 'p3')"""
BLOCKS["job_event"] = """
  select concat('p', cast(user_id % 5 as varchar)) as repository_id, concat('c', cast(user_id as varchar)) as commit_id,
    concat('Job#', cast(user_id as varchar), '-', cast(event_id % 4 as varchar)) as identifier,
    case when event_id % 4 = 0 then 'INGESTION' else 'JOB' end as kind,
    case event_type when 'error' then 'FAILURE' when 'view' then 'IN_PROGRESS' when 'signup' then 'IN_PROGRESS'
      else 'SUCCESS' end as state,
    ts - to_seconds(case when event_id % 7 = 3 then cast(event_id % 3600 as integer) else 0 end) as event_time,
    event_id, ts as stored_time
  from events"""


def states(source: str, keys: str) -> str:
    """Line states of a table of upload lines, within the given key columns."""
    return f"""
  select {keys}, file_name, line_number, bool_or(contains_method) as contains_method,
    bool_or(contains_branch) as contains_branch, bool_or(contains_statement) as contains_statement,
    count(*) filter (where contains_branch) as total_branches,
    count(*) filter (where contains_branch and is_branch_hit) as covered_branches,
    case when sum(hits) = 0 and count(*) filter (where contains_branch and is_branch_hit) = 0 then 'uncovered'
         when bool_and(is_branch_hit) = false then 'partial' else 'covered' end as state
  from ({branching(source, keys)})
  group by {keys}, file_name, line_number"""


def branching(source: str, keys: str) -> str:
    return f"""
    select {keys}, file_name, line_number, branch_index, bool_or(contains_method) as contains_method,
      bool_or(contains_branch) as contains_branch, bool_or(contains_statement) as contains_statement,
      cast(sum(hits) as bigint) as hits, sum(branch_hit) > 0 as is_branch_hit
    from ({exploded(source)})
    group by {keys}, file_name, line_number, branch_index"""


def exploded(source: str) -> str:
    return f"""
      select * exclude (vals), unnest(vals) as branch_hit, cast(generate_subscripts(vals, 1) - 1 as integer) as branch_index
      from (select *, case when len(branch_hits) = 0 then [hits] else branch_hits end as vals from {source})"""


WAYPOINT = "project_id, commit_id"
BLOCKS["unnested"] = """
  select u.project_id, u.commit_id, u.tag, u.total_lines, u.commit_id as source_commit, l.*
  from upload u join line_cov l on u.upload_id = l.upload_id"""
BLOCKS["line_state"] = states("unnested", WAYPOINT)
BLOCKS["candidate"] = """
  select w.project_id, w.commit_id, k.tag
  from waypoint_sparse w
  join (select distinct project_id, tag from upload_sparse) k on k.project_id = w.project_id
  left join tag_settings own on own.repository_id = k.project_id and own.tag = k.tag
  left join tag_settings def on def.repository_id = k.project_id and def.tag is null
  where coalesce(own.carryforward, def.carryforward, true)
    and not exists (select 1 from upload_sparse u
                    where u.project_id = w.project_id and u.commit_id = w.commit_id and u.tag = k.tag)"""
BLOCKS["carried"] = """
  select c.project_id, c.commit_id, c.tag, arg_min(h.ancestor, h.position) as source_commit,
    min(h.position) as position
  from candidate c
  join history h on h.project_id = c.project_id and h.head = c.commit_id
  join (select distinct project_id, commit_id, tag from upload_sparse) a
    on a.project_id = c.project_id and a.commit_id = h.ancestor and a.tag = c.tag
  group by c.project_id, c.commit_id, c.tag"""
BLOCKS["scope_sparse"] = """
  select project_id, commit_id, upload_id, tag, total_lines, commit_id as source_commit, cast(ingest_time as date) as ingest_date
  from upload_sparse
  union
  select c.project_id, c.commit_id, u.upload_id, u.tag, u.total_lines, u.commit_id, cast(u.ingest_time as date)
  from carried c join upload_sparse u
    on u.project_id = c.project_id and u.commit_id = c.source_commit and u.tag = c.tag"""
BLOCKS["scoped_lines"] = """
  select s.project_id, s.commit_id, s.tag, s.total_lines, s.source_commit, l.*
  from scope_sparse s join line_cov l on l.upload_id = s.upload_id"""
BLOCKS["scoped_state"] = states("scoped_lines", WAYPOINT)
BLOCKS["unnested_sparse"] = """
  select u.project_id, u.commit_id, l.* from upload_sparse u join line_cov l on u.upload_id = l.upload_id"""


def _in_diff(source: str, diff: str) -> str:
    return f"""(select n.* from {source} n where exists (select 1 from {diff} d where d.project_id = n.project_id
      and d.commit_id = n.commit_id and d.file_name = n.file_name and d.line_number = n.line_number))"""


BLOCKS["diff_state"] = states(_in_diff("unnested", "diff"), WAYPOINT)
BLOCKS["diff_state_sparse"] = states(_in_diff("unnested_sparse", "diff_sparse"), WAYPOINT)

PERCENT = "(covered + partial) / cast(case when lines = 0 then 1 else lines end as double) * 100.0"


def percent_2dp(part: str, total: str) -> str:
    return f"cast((20000 * ({part}) + ({total})) // (2 * ({total})) as double) / 100.0"


def round_2dp(value: str) -> str:
    return f"sign({value}) * floor(abs({value}) * 100 + 0.5) / 100.0 + 0.0"


COUNTS = """count(*) as lines, count(*) filter (where state = 'covered') as covered,
  count(*) filter (where state = 'partial') as partial, count(*) filter (where state = 'uncovered') as uncovered"""


def query(body: str) -> str:
    """``body`` preceded by the blocks it names, directly or through other blocks."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.add(name)
                visit(BLOCKS[name])

    visit(body)
    blocks = [f"{name} as ({BLOCKS[name]})" for name in BLOCKS if name in needed]
    return (f"with recursive {', '.join(blocks)} " if blocks else "") + body
