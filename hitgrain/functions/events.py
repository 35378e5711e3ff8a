"""Expressions on CI events and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orchestrated states.
IN_PROGRESS, SUCCESS, FAILURE = "IN_PROGRESS", "SUCCESS", "FAILURE"


def map_job_state(event_type: Column, job_state: Column) -> Column:
    """Orchestrated state of an incoming CI event."""
    return (
        F.when(event_type == "INGEST_STARTED", F.lit(IN_PROGRESS))
        .when(event_type == "INGEST_SUCCESS", F.lit(SUCCESS))
        .when(event_type == "INGEST_FAILURE", F.lit(FAILURE))
        .when(job_state == "completed", F.lit(SUCCESS))
        .otherwise(F.lit(IN_PROGRESS))
    )


def is_finished(state: Column) -> Column:
    return state.isin(SUCCESS, FAILURE)


def not_self_triggered(triggered_by: Column, own_app_id: str) -> Column:
    """False for events caused by our own app; an unknown trigger is kept."""
    return ~triggered_by.cast("string").eqNullSafe(F.lit(own_app_id))


def message_group_hash(
    provider: Column, owner: Column, repository: Column, pull_request: Column, commit: Column
) -> Column:
    """Group of a message: one per pull request, or per commit when there is none."""
    return F.md5(F.concat(provider, owner, repository, F.coalesce(pull_request.cast("string"), commit)))


def state_change_diff(current: Column, new: Column, strict_keys: bool = False) -> Column:
    """Entries of ``new`` that are a change from ``current``.

    The default compares values only: a value already present under any key is no change.
    ``strict_keys`` compares per key.
    """
    if strict_keys:
        return F.map_filter(new, lambda key, value: ~F.element_at(current, key).eqNullSafe(value))
    return F.map_filter(new, lambda key, value: ~F.array_contains(F.map_values(current), value))
