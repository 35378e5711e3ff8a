"""Keyed state machine that decides when a commit is complete.

One key is a (repository, commit). State per key: of every job and upload its recorded state, fields and version,
and a commit record with the number of open jobs. The rules are those of ``hitgrain.operators.orchestration``. The
clock is the stored time of events, in which they arrive: an event's own time may lie in any order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hitgrain.functions.events import FAILURE, IN_PROGRESS, SUCCESS
from hitgrain.operators.orchestration import COMMIT, QUIET_PERIOD, STATE_LIFETIME, event_fields

OUTPUT = (
    "repository_id string, commit_id string, output string, identifier string, version bigint, "
    "change map<string,string>, event_us bigint, stored_us bigint"
)
JOB_STATE = "state string, event_us bigint, stored_us bigint, version bigint, fields map<string,string>"
COMMIT_STATE = (
    "last_us bigint, open bigint, oldest_open_us bigint, pending_us bigint, pending_event_us bigint, "
    "complete_us bigint, ingest_us bigint, packs bigint"
)
# About as many jobs of a new commit share an entry of the state store.
PACK = 64
FINISHED = (SUCCESS, FAILURE)


class Job(NamedTuple):
    """A recorded job, with the fields of ``JOB_STATE``."""

    state: str
    event_us: int
    stored_us: int
    version: int
    fields: dict[str, str]


class Event(NamedTuple):
    """An event behind its key, in the order of its columns; ``fields`` is a JSON object, which costs less to hand over than a map."""

    identifier: str
    kind: str
    state: str
    event_id: int
    event_us: int
    stored_us: int
    fields: str


def micros(period: timedelta) -> int:
    return period // timedelta(microseconds=1)


def is_recorded(previous: Job | None, state: str, event_us: int) -> bool:
    """Late events and steps back from finished to in progress are dropped."""
    if previous is None:
        return True
    return event_us >= previous.event_us and not (previous.state in FINISHED and state == IN_PROGRESS)


def changed_fields(current: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Fields of ``new`` whose value is under no field of ``current``, as ``state_change_diff`` has it."""
    known = set(current.values())
    return {name: value for name, value in new.items() if value not in known}


def pack_of(identifier: str | None, packs: int) -> int:
    return zlib.crc32((identifier or "").encode()) % packs


def packed(jobs: dict[str, Job], packs: int) -> dict[int, str]:
    """The jobs of each pack as JSON text."""
    rows: dict[int, list] = {}
    for identifier, job in jobs.items():
        rows.setdefault(pack_of(identifier, packs), []).append([identifier, *job])
    return {number: json.dumps(pack) for number, pack in rows.items()}


def unpacked(text: str) -> dict[str, Job]:
    return {identifier: Job(*job) for identifier, *job in json.loads(text)}


class CommitProcessor(StatefulProcessor):
    """Each call to the state store goes through a socket, so the jobs of a commit that begins with many are stored in packs,
    each read and written whole. What becomes of a job later is stored by itself, and goes before what its pack says.

    ``expire`` leaves the removal of old state to the state store (wall clock); else a timer on the stored clock does it."""

    def __init__(self, quiet: timedelta = QUIET_PERIOD, lifetime: timedelta = STATE_LIFETIME, expire: bool = False):
        self.quiet_us = micros(quiet)
        self.lifetime_us = micros(lifetime)
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.lifetime_us // 1000 if self.expire else None
        self.jobs = handle.getMapState("jobs", "identifier string", JOB_STATE, ttl)
        self.packs = handle.getMapState("packs", "number bigint", "jobs string", ttl)
        self.commit = handle.getValueState("commit", COMMIT_STATE, ttl)

    def _emit(self, key: tuple, output: str, event_us: int, stored_us: int, identifier=None, version=None, change=None) -> Row:
        return Row(
            repository_id=key[0], commit_id=key[1], output=output, identifier=identifier, version=version,
            change=change, event_us=event_us, stored_us=stored_us,
        )

    def _settle(self, key: tuple, record: dict) -> Iterator[Row]:
        """Turn the pending moment into a finalisation when new uploads came in since the last one."""
        complete, ingest = record["complete_us"], record["ingest_us"]
        if complete is None or (ingest is not None and ingest > complete):
            yield self._emit(key, "uploads_finalised", record["pending_event_us"], record["pending_us"])
        record["complete_us"], record["pending_us"] = record["pending_us"], None

    def _alive(self, job: Job | None, now_us: int) -> bool:
        return job is not None and job.stored_us > now_us - self.lifetime_us

    def _stored_job(self, identifier: str, packs: int | None) -> Job | None:
        if self.jobs.containsKey((identifier,)):
            return Job(*self.jobs.getValue((identifier,)))
        number = (pack_of(identifier, packs),) if packs else None
        if number is None or not self.packs.containsKey(number):
            return None
        return unpacked(self.packs.getValue(number)[0]).get(identifier)

    def _stored_jobs(self, packs: int | None) -> dict[str, Job]:
        found: dict[str, Job] = {}
        for (text,) in self.packs.values() if packs else ():
            found.update(unpacked(text))
        return found | {identifier: Job(*job) for (identifier,), job in self.jobs.iterator()}

    def _previous(self, identifier: str, record: dict, jobs: dict[str, Job], known: bool) -> Job | None:
        """``jobs`` holds what this call has read or changed; the store is asked once for a job, and never for a new commit."""
        if identifier not in jobs:
            jobs[identifier] = self._stored_job(identifier, record["packs"]) if known else None
        job = jobs[identifier]
        return job if self._alive(job, record["last_us"]) else None

    def _store_jobs(self, jobs: dict[str, Job], changed: set[str], record: dict, known: bool) -> None:
        if not known and len(changed) > PACK:
            record["packs"] = -(-len(changed) // PACK)
            for number, text in packed({i: jobs[i] for i in changed}, record["packs"]).items():
                self.packs.updateValue((number,), (text,))
            return
        for identifier in changed:
            self.jobs.updateValue((identifier,), tuple(jobs[identifier]))

    def _count_open(self, record: dict, now_us: int, jobs: dict[str, Job], known: bool) -> None:
        """Counted anew only when the oldest open job may have outlived its state; else kept by steps."""
        if record["open"] and record["oldest_open_us"] <= now_us - self.lifetime_us:
            every = (self._stored_jobs(record["packs"]) if known else {}) | jobs
            times = [job.stored_us for job in every.values() if self._alive(job, now_us) and job.state == IN_PROGRESS]
            record["open"], record["oldest_open_us"] = len(times), min(times, default=None)

    def _set_timer(self, record: dict, known: bool = True) -> None:
        """One timer a commit: the end of the quiet period, or else of its state's life. A new commit has none yet."""
        for timer in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(timer)
        if record["pending_us"] is not None:
            self.handle.registerTimer((record["pending_us"] + self.quiet_us) // 1000 + 1)
        elif not self.expire:
            self.handle.registerTimer((record["last_us"] + self.lifetime_us) // 1000 + 1)

    def _load(self) -> dict | None:
        stored = self.commit.get()
        return dict(zip(COMMIT_FIELDS, stored, strict=True)) if stored is not None else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        record = self._load()
        known, jobs, changed = record is not None, {}, set()
        for row in sorted((Event(*row[KEYS:EVENT_END]) for row in rows), key=lambda e: (e.stored_us, e.event_id)):
            now_us = row.stored_us
            if record is None:
                record = dict.fromkeys(COMMIT_FIELDS) | {"open": 0}
                yield self._emit(key, "uploads_started", row.event_us, now_us)
            record["last_us"] = now_us
            self._count_open(record, now_us, jobs, known)
            previous = self._previous(row.identifier, record, jobs, known)
            if not is_recorded(previous, row.state, row.event_us):
                continue
            if record["pending_us"] is not None:
                if now_us - record["pending_us"] >= self.quiet_us:
                    yield from self._settle(key, record)
                else:
                    record["pending_us"] = None
            fields = dict(previous.fields) if previous is not None else {}
            new = json.loads(row.fields)
            change = changed_fields(fields, new) if previous is not None else new
            version = (previous.version if previous is not None else 0) + bool(change)
            if change:
                yield self._emit(key, "state_change", row.event_us, now_us, row.identifier, version, change)
            jobs[row.identifier] = Job(row.state, row.event_us, now_us, version, {**fields, **change})
            changed.add(row.identifier)
            was_open = previous is not None and previous.state == IN_PROGRESS
            record["open"] += (row.state == IN_PROGRESS) - was_open
            if row.state == IN_PROGRESS and record["oldest_open_us"] is None:
                record["oldest_open_us"] = now_us
            if not record["open"]:
                record["oldest_open_us"] = None
            ingested = row.kind == "INGESTION" and row.state in FINISHED
            if ingested:
                record["ingest_us"] = now_us
            if (ingested or (row.kind != "INGESTION" and row.state == SUCCESS)) and not record["open"]:
                record["pending_us"], record["pending_event_us"] = now_us, row.event_us
        if record is not None:
            self._store_jobs(jobs, changed, record, known)
            self._set_timer(record, known)
            self.commit.update(tuple(record.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        record = self._load()
        if record is None:
            return
        now_us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if record["pending_us"] is not None and now_us >= record["pending_us"] + self.quiet_us:
            yield from self._settle(key, record)
        # The clock may have passed more than this timer, and no further batch may come.
        if not self.expire and timerValues.getCurrentWatermarkInMs() * 1000 >= record["last_us"] + self.lifetime_us:
            self.jobs.clear()
            if record["packs"]:
                self.packs.clear()
            self.commit.clear()
        else:
            self._set_timer(record)
            self.commit.update(tuple(record.values()))

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


COMMIT_FIELDS = _names(COMMIT_STATE)
KEYS, EVENT_END = len(COMMIT), len(COMMIT) + len(Event._fields)


def orchestrate(
    events: DataFrame,
    quiet: timedelta = QUIET_PERIOD,
    delay: str = "1 minute",
    lifetime: timedelta = STATE_LIFETIME,
    fields: dict[str, Column] | None = None,
    wall_clock: bool = False,
) -> DataFrame:
    """Stream of ``uploads_started``, ``state_change`` and ``uploads_finalised`` from a stream of CI events.

    By default timers follow the stored times of all events, so that a replay gives what the first run gave; ``delay``
    is how far the files or partitions of the source may lag behind each other in stored time. However old an event's
    own time is, it reaches the rules. With ``wall_clock`` timers go by processing time, so that a commit is finalised
    though no further event comes in, and the state store removes state at the end of its life.
    ``fields`` are the fields of an event that are versioned.
    """
    named = F.create_map(*[c for f in (fields or event_fields()).items() for c in (F.lit(f[0]), f[1])])
    timed = events.select(
        *COMMIT, "identifier", "kind", "state", "event_id",
        F.unix_micros(F.col("event_time").cast("timestamp")).alias("event_us"),
        F.unix_micros(F.col("stored_time").cast("timestamp")).alias("stored_us"),
        F.to_json(F.map_filter(named, lambda k, v: v.isNotNull())).alias("fields"),
        F.col("stored_time").cast("timestamp").alias("stored_ts"),
    )
    if not wall_clock:
        timed = timed.withWatermark("stored_ts", delay)
    return timed.groupBy(*COMMIT).transformWithState(
        statefulProcessor=CommitProcessor(quiet, lifetime, expire=wall_clock),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if wall_clock else "EventTime",
    )
