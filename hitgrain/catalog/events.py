"""Queries on CI event states."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.catalog import Query
from hitgrain.catalog import sql as S
from hitgrain.functions import events as E
from hitgrain.operators import orchestration as O
from hitgrain.sources import bind

QUIET = timedelta(minutes=30)


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def screened(spark: SparkSession, d: str) -> DataFrame:
    return O.screen_events(bind.job_events(spark, d))


def recorded(spark: SparkSession, d: str) -> DataFrame:
    return O.recorded_events(bind.job_events(spark, d))


def states(spark: SparkSession, d: str) -> DataFrame:
    return O.latest_states(recorded(spark, d))


def changes(spark: SparkSession, d: str) -> DataFrame:
    return O.event_state_changes(recorded(spark, d))


def with_finalisations(spark: SparkSession, d: str) -> DataFrame:
    """Job states in which every fourth event counts as a finalisation."""
    kind = F.when(F.col("event_id") % 4 == 1, F.lit("FINALISED")).otherwise(F.col("kind"))
    events = bind.job_events(spark, d).withColumn("kind", kind)
    return O.latest_states(O.recorded_events(events))


def q_already_finalised(spark: SparkSession, d: str) -> DataFrame:
    st = with_finalisations(spark, d)
    now = bind.job_events(spark, d).agg(F.max("event_time")).scalar()
    return O.already_finalised(st, now)


def q_state_ttl(spark: SparkSession, d: str) -> DataFrame:
    now = bind.job_events(spark, d).agg(F.max("event_time")).scalar()
    return O.state_ttl(states(spark, d), now).select(*O.IDENTITY, "state", stamp("event_time"))


def q_state_change_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two small states per event, compared by values and by keys."""
    ev = bind.table(spark, d, "events")
    user = (F.col("user_id") % 3).cast("string")
    current = F.create_map(F.lit("a"), user, F.lit("b"), F.lit("1"), F.lit("c"), F.col("event_type"))
    new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), user, F.lit("c"), F.lit("click"))

    def shown(strict: bool) -> Column:
        return F.array_join(
            F.transform(F.map_entries(E.state_change_diff(current, new, strict)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        )

    return ev.select("event_id", shown(False).alias("by_value"), shown(True).alias("by_key"))


def q_map_job_state(spark: SparkSession, d: str) -> DataFrame:
    ev = bind.table(spark, d, "events")
    kind = (
        F.when(F.col("event_type") == "view", F.lit("INGEST_STARTED"))
        .when(F.col("event_type") == "click", F.lit("INGEST_SUCCESS"))
        .when(F.col("event_type") == "error", F.lit("INGEST_FAILURE"))
        .otherwise(F.lit("JOB_STATE_CHANGE"))
    )
    job = F.when(F.col("event_type") == "purchase", F.lit("completed")).otherwise(F.lit("queued"))
    return ev.select("event_id", E.map_job_state(kind, job).alias("state"))


def q_finalise_outcome(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", F.lit("COVERAGE_FINALISED")).when(
        F.col("event_type") == "error", F.lit("COVERAGE_FAILED")
    )
    ev = bind.table(spark, d, "events").select("event_id", kind.alias("type"))
    return O.finalise_outcome(bind.job_events(spark, d).join(ev, "event_id"))


def q_event_state_changes(spark: SparkSession, d: str) -> DataFrame:
    change = F.col("change")
    return changes(spark, d).select(
        *O.IDENTITY,
        F.col("version").cast("bigint").alias("version"),
        *[F.element_at(change, key).alias(f"changed_{key.lower()}") for key in ("type", "state", "eventTime")],
    )


def q_event_state_fold(spark: SparkSession, d: str) -> DataFrame:
    state = F.col("state")
    return O.event_state_fold(changes(spark, d)).select(
        *O.IDENTITY,
        *[F.element_at(state, key).alias(key.lower()) for key in ("type", "state", "eventTime")],
        F.col("version").cast("bigint").alias("version"),
    )


EVENT_COLUMNS = [*O.IDENTITY, "state", "event_id"]
QUERIES: dict[str, Query] = {
    "drop_late_events": lambda s, d: O.drop_late_events(screened(s, d)).select(*EVENT_COLUMNS),
    "drop_state_regressions": lambda s, d: O.drop_state_regressions(screened(s, d)).select(*EVENT_COLUMNS),
    "event_state_changes": q_event_state_changes,
    "event_state_fold": q_event_state_fold,
    "state_change_diff": q_state_change_diff,
    "map_job_state": q_map_job_state,
    "ignore_self_triggered": lambda s, d: bind.table(s, d, "events")
    .withColumn("app_id", F.when(F.col("event_type") != "view", F.col("user_id") % 10))
    .filter(E.not_self_triggered(F.col("app_id"), "7"))
    .select("event_id", "app_id"),
    "uploads_started": lambda s, d: O.uploads_started(bind.job_events(s, d)).select(*O.COMMIT, stamp("event_time")),
    "ongoing_events": lambda s, d: O.ongoing_events(states(s, d)),
    "newer_event_recorded": lambda s, d: O.newer_event_recorded(states(s, d)),
    "already_finalised": q_already_finalised,
    "uploads_finalised": lambda s, d: O.uploads_finalised(recorded(s, d), QUIET).select(
        *O.COMMIT, stamp("event_time"), stamp("stored_time")
    ),
    "finalise_outcome": q_finalise_outcome,
    "state_ttl": q_state_ttl,
}

_ID = "repository_id, commit_id, identifier"


def screen_sql(source: str) -> str:
    before = "over (partition by identifier order by event_id rows between unbounded preceding and 1 preceding)"
    return f"""
  select *, case when event_time < state_time then 'late'
      when state = 'IN_PROGRESS' and finished_before then 'regression' end as dropped
  from (
    select *, case when finished_before then finish_before else ongoing_before end as state_time
    from (
      select *, coalesce(bool_or(finishes) {before}, false) as finished_before
      from (
        select *, state <> 'IN_PROGRESS' and coalesce(event_time >= ongoing_before, true) as finishes
        from (
          select *, max(case when state = 'IN_PROGRESS' then event_time end) {before} as ongoing_before,
            max(case when state <> 'IN_PROGRESS' then event_time end) {before} as finish_before
          from {source}))))"""


S.BLOCKS["screened"] = screen_sql("job_event")
S.BLOCKS["recorded"] = "select * from screened where dropped is null"
S.BLOCKS["job_state"] = """
  select repository_id, commit_id, identifier, arg_max(kind, event_id) as kind, arg_max(state, event_id) as state,
    max(event_time) as event_time, max(stored_time) as stored_time
  from recorded group by repository_id, commit_id, identifier"""
S.BLOCKS["final_event"] = """
  select * replace (case when event_id % 4 = 1 then 'FINALISED' else kind end as kind) from job_event"""
S.BLOCKS["final_screened"] = screen_sql("final_event")
S.BLOCKS["final_state"] = """
  select repository_id, commit_id, identifier, arg_max(kind, event_id) as kind, arg_max(state, event_id) as state,
    max(event_time) as event_time
  from final_screened where dropped is null group by repository_id, commit_id, identifier"""
S.BLOCKS["state_step"] = """
  select *, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') as time_text,
    lag(state) over (partition by identifier order by event_id) as was_state,
    lag(event_time) over (partition by identifier order by event_id) as was_time
  from recorded"""
S.BLOCKS["state_change"] = """
  select repository_id, commit_id, identifier, row_number() over (partition by identifier order by event_id) as version,
    case when was_state is null then kind end as changed_type,
    case when state is distinct from was_state then state end as changed_state,
    case when event_time is distinct from was_time then time_text end as changed_eventtime, event_time, stored_time
  from state_step where state is distinct from was_state or event_time is distinct from was_time"""
S.BLOCKS["finalised_moment"] = """
  select * from (
    select *, max(case when complete then stored_time end) over (partition by repository_id, commit_id
        order by stored_time, event_id rows between unbounded preceding and 1 preceding) as previous,
      max(case when kind = 'INGESTION' and state <> 'IN_PROGRESS' then stored_time end) over (
        partition by repository_id, commit_id order by stored_time, event_id rows unbounded preceding) as ingested
    from (
      select *, (case when kind = 'INGESTION' then state <> 'IN_PROGRESS' else state = 'SUCCESS' end)
        and sum(step) over (partition by repository_id, commit_id order by stored_time, event_id rows unbounded preceding) = 0
        and coalesce(lead(stored_time) over (partition by repository_id, commit_id order by stored_time, event_id)
          - stored_time >= interval 30 minutes, true) as complete
      from (
        select *, cast(state = 'IN_PROGRESS' as integer) - coalesce(lag(cast(state = 'IN_PROGRESS' as integer))
          over (partition by identifier order by stored_time, event_id), 0) as step from recorded)))
  where complete and (previous is null or ingested > previous)"""
_STAMP = "strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') as event_time"

ORACLES: dict[str, str] = {
    "drop_late_events": S.query(
        f"select {_ID}, state, event_id from screened where dropped is distinct from 'late'"
    ),
    "drop_state_regressions": S.query(
        f"select {_ID}, state, event_id from screened where dropped is distinct from 'regression'"
    ),
    "event_state_changes": S.query(f"select {_ID}, version, changed_type, changed_state, changed_eventtime from state_change"),
    "event_state_fold": S.query(
        f"""select s.repository_id, s.commit_id, s.identifier, s.kind as type, s.state,
          strftime(s.event_time, '%Y-%m-%d %H:%M:%S.%f') as eventtime, c.version
        from job_state s join (select identifier, max(version) as version from state_change group by identifier) c
          on c.identifier = s.identifier"""
    ),
    "state_change_diff": """
        select event_id,
          concat_ws(',', case when not list_contains(vals, '1') then 'a=1' end, case when not list_contains(vals, u) then concat('b=', u) end,
            case when not list_contains(vals, 'click') then 'c=click' end) as by_value,
          concat_ws(',', case when u <> '1' then 'a=1' end, case when u <> '1' then concat('b=', u) end,
            case when event_type <> 'click' then 'c=click' end) as by_key
        from (select event_id, event_type, cast(user_id % 3 as varchar) as u, [cast(user_id % 3 as varchar), '1', event_type] as vals from events)""",
    "map_job_state": """
        select event_id, case event_type when 'view' then 'IN_PROGRESS' when 'click' then 'SUCCESS' when 'error' then 'FAILURE'
          when 'purchase' then 'SUCCESS' else 'IN_PROGRESS' end as state from events""",
    "ignore_self_triggered": """
        select event_id, case when event_type <> 'view' then user_id % 10 end as app_id from events
        where case when event_type <> 'view' then user_id % 10 end is distinct from 7""",
    "uploads_started": S.query(
        f"""select repository_id, commit_id, {_STAMP} from (
          select repository_id, commit_id, arg_min(event_time, event_id) as event_time from job_event group by 1, 2)"""
    ),
    "ongoing_events": S.query(
        f"""select {_ID}, exists (select 1 from job_state o where o.repository_id = s.repository_id and o.commit_id = s.commit_id
          and o.identifier <> s.identifier and o.state = 'IN_PROGRESS') as others_ongoing from job_state s"""
    ),
    "newer_event_recorded": S.query(
        f"""select {_ID}, row_number() over (partition by repository_id, commit_id order by epoch(date_trunc('second', stored_time)) desc, identifier) > 1 as newer
        from job_state"""
    ),
    "already_finalised": S.query(
        """select repository_id, commit_id, coalesce(final_time is not null
          and not (final_state = 'IN_PROGRESS' and final_time < (select max(event_time) from job_event) - interval 3 minutes)
          and not coalesce(ingested > final_time, false), false) as already_finalised
        from (
          select repository_id, commit_id, max(event_time) filter (where kind = 'FINALISED') as final_time,
            max({'t': event_time, 's': state}) filter (where kind = 'FINALISED').s as final_state,
            max(event_time) filter (where kind = 'INGESTION' and state <> 'IN_PROGRESS') as ingested
          from final_state group by repository_id, commit_id)"""
    ),
    "uploads_finalised": S.query(
        f"select repository_id, commit_id, {_STAMP}, {_STAMP.replace('event_time', 'stored_time')} from finalised_moment"
    ),
    "finalise_outcome": S.query(
        """select repository_id, commit_id, arg_max(case event_type when 'purchase' then 'SUCCESS' else 'FAILURE' end,
          {'t': j.event_time, 'i': j.event_id}) as state
        from job_event j join events e on e.event_id = j.event_id where event_type in ('purchase', 'error')
        group by repository_id, commit_id"""
    ),
    "state_ttl": S.query(
        f"""select {_ID}, state, {_STAMP} from job_state
        where event_time >= (select max(event_time) from job_event) - interval 43200 seconds"""
    ),
}
