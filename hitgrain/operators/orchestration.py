"""CI event states of commits, in batch form.

Events are (repository_id, commit_id, identifier, kind, state, event_time,
event_id, stored_time); ``event_id`` is the order of arrival and ``stored_time`` when an event arrived, which rises with it. The streaming form of the same
rules is in ``hitgrain.streaming.orchestrator``.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.functions.events import FAILURE, IN_PROGRESS, SUCCESS, is_finished
from hitgrain.operators.sequence import carry, chunk_window, earlier_chunks, later_chunks, with_chunk

COMMIT = ["repository_id", "commit_id"]
IDENTITY = [*COMMIT, "identifier"]

# Events of one job or commit that share a window task: by arrival number, and by seconds.
EVENT_SPAN = 1_000_000
TIME_SPAN = 86_400

# Age after which an unfinished finalisation counts as lost, and the life of a stored state.
MAX_FINALISE_AGE = timedelta(minutes=3)
STATE_LIFETIME = timedelta(seconds=43_200)
QUIET_PERIOD = timedelta(seconds=6)


def screen_events(events: DataFrame, span: int = EVENT_SPAN) -> DataFrame:
    """Add ``dropped``: NULL for events that are recorded, else ``late`` or ``regression``.

    An event is late when it is older than the recorded state of its job; it is
    a regression when it would move a finished job back to in progress. So
    until the first recorded finish only in-progress events count, after it
    only finished ones, and each recorded time is the maximum so far.
    ``was_ongoing`` tells whether the recorded state before the event was in progress.

    A chunk's finish counts when one that is in time within the chunk is also
    not older than the latest in-progress event of earlier chunks, so one
    maximum per chunk is enough to carry.
    """
    ongoing = F.col("state") == IN_PROGRESS
    ongoing_time = F.when(ongoing, F.col("event_time"))
    finish_time = F.when(~ongoing, F.col("event_time"))
    before = chunk_window(IDENTITY, F.col("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = earlier_chunks(IDENTITY)
    local = (
        with_chunk(events, F.col("event_id"), span)
        .withColumn("ongoing_local", F.max(ongoing_time).over(before))
        .withColumn("finish_local", F.max(finish_time).over(before))
        .withColumn(
            "in_time_finish",
            F.when(F.col("ongoing_local").isNull() | (finish_time >= F.col("ongoing_local")), finish_time),
        )
    )
    known = carry(
        local,
        IDENTITY,
        {"o": F.max(ongoing_time), "f": F.max(finish_time), "q": F.max("in_time_finish")},
        {"ongoing_carried": F.max("o").over(earlier), "finish_carried": F.max("f").over(earlier)},
        {
            "finishes": F.col("q").isNotNull()
            & (F.col("ongoing_carried").isNull() | (F.col("q") >= F.col("ongoing_carried")))
        },
        {"finished_carried": F.coalesce(F.max("finishes").over(earlier), F.lit(False))},
    )
    finishes_here = F.col("in_time_finish").isNotNull() & (
        F.col("ongoing_carried").isNull() | (F.col("in_time_finish") >= F.col("ongoing_carried"))
    )
    finished = F.col("finished_carried") | F.coalesce(F.max(finishes_here).over(before), F.lit(False))
    ongoing_before = F.greatest("ongoing_local", "ongoing_carried")
    state_time = F.when(F.col("finished"), F.greatest("finish_local", "finish_carried")).otherwise(ongoing_before)
    dropped = F.when(F.col("event_time") < state_time, F.lit("late")).when(
        ongoing & F.col("finished"), F.lit("regression")
    )
    return known.withColumn("finished", finished).select(
        *events.columns,
        dropped.alias("dropped"),
        (~F.col("finished") & ongoing_before.isNotNull()).alias("was_ongoing"),
    )


def drop_late_events(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("dropped").eqNullSafe("late"))


def drop_state_regressions(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("dropped").eqNullSafe("regression"))


def recorded_events(events: DataFrame, span: int = EVENT_SPAN) -> DataFrame:
    return screen_events(events, span).filter(F.col("dropped").isNull()).drop("dropped")


def latest_states(recorded: DataFrame) -> DataFrame:
    """Current state of every job, upload and finalisation of a commit, and when its last change was stored."""
    latest = F.max_by(F.struct("kind", "state", "event_time"), F.struct("event_time", "event_id"))
    stored = F.max("stored_time").alias("stored_time")
    return recorded.groupBy(*IDENTITY).agg(latest.alias("latest"), stored).select(*IDENTITY, "latest.*", "stored_time")


def event_fields() -> dict[str, Column]:
    """The versioned fields of an event, as texts."""
    time = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return {"type": F.col("kind"), "state": F.col("state"), "eventTime": time}


def event_state_changes(
    recorded: DataFrame, span: int = EVENT_SPAN, fields: dict[str, Column] | None = None
) -> DataFrame:
    """Versioned differences between the recorded states of each identifier.

    The first version holds all fields, later ones the fields that changed;
    an event that changes nothing makes no version. Fields are compared one by one. Where the values of
    different fields never coincide, as those of ``event_fields``, this is what comparing values alone gives;
    the stream compares values.
    """
    columns = fields or event_fields()
    names = list(columns)
    order, earlier = chunk_window(IDENTITY, F.col("event_id")), earlier_chunks(IDENTITY)
    local = (
        with_chunk(recorded, F.col("event_id"), span)
        .withColumn("now", F.struct(*[c.alias(name) for name, c in columns.items()]))
        .withColumn("was_local", F.lag("now").over(order))
    )
    inner_change = F.col("was_local").isNotNull() & (F.col("now") != F.col("was_local"))
    known = carry(
        local,
        IDENTITY,
        {
            "first_here": F.min_by("now", "event_id"),
            "last_here": F.max_by("now", "event_id"),
            "inner": F.count_if(inner_change),
        },
        {"was_carried": F.last("last_here").over(earlier)},
        {"opens": (~F.col("first_here").eqNullSafe(F.col("was_carried"))).cast("bigint")},
        {"versions_before": F.coalesce(F.sum(F.col("inner") + F.col("opens")).over(earlier), F.lit(0))},
    )
    was = F.coalesce("was_local", "was_carried")
    known = known.withColumn("was", was).withColumn("changes", (~F.col("now").eqNullSafe(F.col("was"))).cast("bigint"))
    version = F.col("versions_before") + F.sum("changes").over(order)
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"now.{name}").eqNullSafe(F.col(f"was.{name}")),
                    F.struct(F.lit(name).alias("key"), F.col(f"now.{name}").alias("value")),
                )
                for name in names
            ]
        )
    )
    return (
        known.withColumn("version", version)
        .filter(F.col("changes") == 1)
        .select(*IDENTITY, "version", F.map_from_entries(entries).alias("change"), "event_time", "event_id")
    )


def event_state_fold(changes: DataFrame) -> DataFrame:
    """State of each identifier rebuilt from its versioned changes.

    A later change with the same version replaces the earlier one; per field
    the highest version wins. Both are maxima that combine before the shuffle,
    and the collected map has one entry per field.
    """
    one_per_version = changes.groupBy(*IDENTITY, "version").agg(F.max_by("change", "event_id").alias("change"))
    fields = one_per_version.select(*IDENTITY, "version", F.explode("change").alias("key", "value"))
    newest = fields.groupBy(*IDENTITY, "key").agg(
        F.max_by("value", "version").alias("value"), F.max("version").alias("field_version")
    )
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return newest.groupBy(*IDENTITY).agg(
        F.map_from_entries(entries).alias("state"), F.max("field_version").alias("version")
    )


def uploads_started(events: DataFrame) -> DataFrame:
    """One row per commit: its first event to arrive."""
    first = F.min(F.struct("event_id", "event_time"))
    return events.groupBy(*COMMIT).agg(first.alias("first")).select(*COMMIT, "first.event_time")


def ongoing_events(states: DataFrame) -> DataFrame:
    """Per identifier, whether any other event of its commit is still in progress."""
    ongoing = F.col("state") == IN_PROGRESS
    totals = states.groupBy(*COMMIT).agg(F.count_if(ongoing).alias("n"))
    return states.join(totals, COMMIT).select(
        *IDENTITY, (F.col("n") - ongoing.cast("int") > 0).alias("others_ongoing")
    )


def newer_event_recorded(states: DataFrame) -> DataFrame:
    """Per identifier, whether the change of the commit that was stored last belongs to another event.

    Stored times count in whole seconds, whatever the events' own times say; of changes in the same second the smallest identifier's counts.
    """
    age = -F.unix_seconds(F.col("stored_time").cast("timestamp"))
    newest = states.groupBy(*COMMIT).agg(F.min(F.struct(age.alias("age"), "identifier")).alias("newest"))
    return states.join(newest, COMMIT).select(*IDENTITY, (F.col("identifier") != F.col("newest.identifier")).alias("newer"))


def already_finalised(states: DataFrame, now: Column) -> DataFrame:
    """Per commit, whether its last finalisation still stands.

    It does when it exists, is not an old unfinished one, and no upload was
    taken in after it.
    """
    final = F.when(F.col("kind") == "FINALISED", F.struct("event_time", "state"))
    ingest = F.when((F.col("kind") == "INGESTION") & (F.col("state") != IN_PROGRESS), F.col("event_time"))
    per_commit = states.groupBy(*COMMIT).agg(
        F.max(final).alias("final"), F.max(ingest).alias("ingested"), F.max("event_time").alias("last_time")
    )
    lost = (F.col("final.state") == IN_PROGRESS) & (F.col("final.event_time") < now - F.lit(MAX_FINALISE_AGE))
    stands = F.col("final").isNotNull() & ~lost & ~F.coalesce(
        F.col("ingested") > F.col("final.event_time"), F.lit(False)
    )
    return per_commit.select(*COMMIT, F.coalesce(stands, F.lit(False)).alias("already_finalised"))


def uploads_finalised(recorded: DataFrame, quiet: timedelta = QUIET_PERIOD, span: int = TIME_SPAN) -> DataFrame:
    """Moments at which a commit became complete. ``recorded`` is the output of ``recorded_events``.

    All recorded events of a commit are replayed in the order in which they were stored. A moment counts
    when a finished event leaves nothing in progress and nothing else is stored
    for the quiet period. After the first moment another one needs an upload
    taken in since the moment before. Each later finalisation is assumed to be
    reported before the next event. ``event_time`` is the event's own time, ``stored_time`` that of the moment.
    """
    ongoing = (F.col("state") == IN_PROGRESS).cast("int")
    ingest_time = F.when((F.col("kind") == "INGESTION") & is_finished(F.col("state")), F.col("stored_time"))
    seconds = F.call_function("div", F.unix_micros(F.col("stored_time").cast("timestamp")), F.lit(1_000_000))
    order = chunk_window(COMMIT, F.col("stored_time"), F.col("event_id"))
    before, after = earlier_chunks(COMMIT), later_chunks(COMMIT)
    stepped = with_chunk(recorded, seconds, span).withColumn("step", ongoing - F.col("was_ongoing").cast("int"))
    known = carry(
        stepped,
        COMMIT,
        {"steps": F.sum("step"), "first_time": F.min("stored_time"), "i": F.max(ingest_time)},
        {
            "open_carried": F.coalesce(F.sum("steps").over(before), F.lit(0)),
            "next_carried": F.first("first_time").over(after),
            "ingest_carried": F.max("i").over(before),
        },
    )
    next_time = F.coalesce(F.lead("stored_time").over(order), F.col("next_carried"))
    still_open = F.col("open_carried") + F.sum("step").over(order)
    triggers = F.when(F.col("kind") == "INGESTION", is_finished(F.col("state"))).otherwise(F.col("state") == SUCCESS)
    quiet_after = F.coalesce(next_time - F.col("stored_time") >= F.lit(quiet), F.lit(True))
    moments = (
        known.withColumn("complete", triggers & (still_open == 0) & quiet_after)
        .withColumn("ingested", F.greatest(F.max(ingest_time).over(order), F.col("ingest_carried")))
        .filter("complete")
    )
    # Moments of a commit are at least a quiet period apart, so there are few of them.
    previous = F.lag("stored_time").over(Window.partitionBy(*COMMIT).orderBy("stored_time", "event_id"))
    return (
        moments.withColumn("previous", previous)
        .filter(F.col("previous").isNull() | (F.col("ingested") > F.col("previous")))
        .select(*COMMIT, "event_time", "stored_time")
    )


def finalise_outcome(outcomes: DataFrame) -> DataFrame:
    """Outcome of each commit's finalisation from (…, type, event_time, event_id)."""
    state = F.when(F.col("type") == "COVERAGE_FINALISED", F.lit(SUCCESS)).when(
        F.col("type") == "COVERAGE_FAILED", F.lit(FAILURE)
    )
    return (
        outcomes.withColumn("state", state)
        .filter(F.col("state").isNotNull())
        .groupBy(*COMMIT)
        .agg(F.max_by("state", F.struct("event_time", "event_id")).alias("state"))
    )


def state_ttl(states: DataFrame, now: Column) -> DataFrame:
    """States that have not expired."""
    return states.filter(F.col("event_time") >= now - F.lit(STATE_LIFETIME))
