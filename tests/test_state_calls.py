"""The state machine asks its store per job, not per event."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import Row

from hitgrain.streaming.orchestrator import CommitProcessor


class Calls(dict):
    """A map state that counts the calls to it."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def exists(self):
        self.calls += 1
        return bool(self)


class Value:
    stored = None

    def get(self):
        return self.stored

    def exists(self):
        return self.stored is not None

    def update(self, value):
        self.stored = value


class Timers(list):
    def listTimers(self):
        return iter(self)

    def deleteTimer(self, timer):
        self.remove(timer)

    def registerTimer(self, timer):
        self.append(timer)


def event(identifier, state, number):
    fields = json.dumps({"state": state})
    return Row(*["repository_id", "commit_id", "identifier", "kind", "state", "event_id", "event_us", "stored_us", "fields", "stored_ts"])(
        "r", "c", identifier, "JOB", state, number, number, number, fields, None
    )


def test_state_store_is_asked_per_job_not_per_event():
    machine = CommitProcessor(timedelta(seconds=1), timedelta(days=1))
    machine.jobs, machine.commit, machine.handle = Calls(), Value(), Timers()
    states = ["IN_PROGRESS", "SUCCESS"] * 50
    first = [event(job, state, n) for n, state in enumerate(states, 1) for job in ("a", "b")]
    out = list(machine.handleInputRows(("r", "c"), iter(first), None))
    assert [row.output for row in out] == ["uploads_started"] + ["state_change"] * 4
    assert machine.jobs.calls == 2
    assert machine.jobs[("a",)][0] == "SUCCESS"
    # A commit that is known has each of its jobs read once and written once.
    later = [event("a", "FAILURE", n) for n in range(200, 240)]
    out = list(machine.handleInputRows(("r", "c"), iter(later), None))
    assert [(row.output, row.version) for row in out] == [("state_change", 3)]
    assert machine.jobs.calls == 2 + 3
    assert len(machine.handle) == 1
