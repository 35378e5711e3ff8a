"""Jobs of a commit that begins with many are stored in packs, and decide the same as jobs stored one by one."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from test_state_calls import Calls, Timers, Value, event

from hitgrain.streaming import orchestrator
from hitgrain.streaming.orchestrator import CommitProcessor


class Store(Calls):
    def iterator(self):
        return iter(self.items())


def machine(lifetime=timedelta(days=1)):
    made = CommitProcessor(timedelta(microseconds=20), lifetime)
    made.jobs, made.packs, made.commit, made.handle = Store(), Store(), Value(), Timers()
    return made


def test_a_commit_that_begins_with_many_jobs_asks_its_store_per_pack():
    made = machine()
    out = list(made.handleInputRows(("r", "c"), iter([event(f"j{n}", "SUCCESS", n) for n in range(1, 6401)]), None))
    assert len(out) == 6401
    assert made.jobs.calls + made.packs.calls <= 6400 // orchestrator.PACK
    # One job of them later costs the same few calls as ever, and is stored by itself.
    made.jobs.calls = made.packs.calls = 0
    out = list(made.handleInputRows(("r", "c"), iter([event("j7", "FAILURE", n) for n in range(7000, 7040)]), None))
    assert [(row.output, row.version) for row in out if row.output == "state_change"] == [("state_change", 2)]
    assert made.jobs.calls + made.packs.calls <= 4
    assert list(made.jobs) == [("j7",)]
    # What is stored by itself goes before the pack; others are still found in theirs.
    later = [event("j7", "SUCCESS", 8000), event("j8", "FAILURE", 8001), event("new", "SUCCESS", 8002), event("j9", "IN_PROGRESS", 8003)]
    out = list(made.handleInputRows(("r", "c"), iter(later), None))
    assert [(row.identifier, row.version) for row in out if row.output == "state_change"] == [("j7", 3), ("j8", 2), ("new", 1)]


@pytest.mark.parametrize("lifetime", [timedelta(days=1), timedelta(microseconds=150)])
@pytest.mark.parametrize("seed", range(5))
def test_packs_change_no_decision(monkeypatch, seed, lifetime):
    draw = random.Random(seed)
    names = [f"j{n}" for n in range(60)] + [None]
    batches, clock = [], 0
    for size in (300, 40, 1, 25, 200):
        batch = []
        for _ in range(size):
            clock += draw.randint(1, 30 if draw.random() < 0.1 else 2)
            batch.append(event(draw.choice(names), draw.choice(["IN_PROGRESS", "SUCCESS", "SUCCESS", "FAILURE"]), clock))
        batches.append(batch)

    def run(pack):
        monkeypatch.setattr(orchestrator, "PACK", pack)
        made = machine(lifetime)
        out = [list(made.handleInputRows(("r", "c"), iter(batch), None)) for batch in batches]
        return out, bool(made.packs), dict(zip(orchestrator.COMMIT_FIELDS, made.commit.stored, strict=True)) | {"packs": None}

    packed, used, record = run(8)
    single, unused, plain = run(10**6)
    assert used and not unused
    assert packed == single and record == plain
