"""Named queries on the driver tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from hitgrain.catalog import coverage, events, ingest, reports, scoping, settings, streams

    merged: dict[str, Query] = {}
    for module in (coverage, scoping, reports, ingest, events, settings, streams):
        merged.update(module.QUERIES)
    return merged


def all_oracles() -> dict[str, str]:
    from hitgrain.catalog import coverage, events, ingest, reports, scoping, settings, streams

    merged: dict[str, str] = {}
    for module in (coverage, scoping, reports, ingest, events, settings, streams):
        merged.update(module.ORACLES)
    return merged
