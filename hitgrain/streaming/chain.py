"""From the outcomes of an ingest stream to the reports of complete commits, as a chain of streams.

Each link writes a table that the next reads as a stream: ``ingest_stream`` its outcomes, ``decide`` what the state
machine puts out, ``report_decided`` the reports of commits that became complete. A link that is started again goes on from its own
checkpoint. An outcome that is read twice has no effect the second time, as it changes no state.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hitgrain.functions.events import FAILURE, IN_PROGRESS, SUCCESS
from hitgrain.operators.orchestration import QUIET_PERIOD, STATE_LIFETIME
from hitgrain.streaming.jobs import Tables, coverage_stream
from hitgrain.streaming.orchestrator import OUTPUT, orchestrate

OUTCOMES = "upload_id string, project_id string, commit_id string, format string, state string, reasons array<string>, ingest_time timestamp_ntz"


def stored_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcomes of an ingest stream as a stream, of all its micro-batches and states."""
    return spark.readStream.schema(f"{OUTCOMES}, batch bigint").parquet(path)


def ingest_events(outcomes: DataFrame) -> DataFrame:
    """Outcomes as the events that ``orchestrate`` takes: one job per upload, at its ingest time."""
    state = (
        F.when(F.col("state") == "INGEST_SUCCESS", F.lit(SUCCESS))
        .when(F.col("state") == "INGEST_FAILURE", F.lit(FAILURE))
        .otherwise(F.lit(IN_PROGRESS))
    )
    return outcomes.select(
        F.col("project_id").alias("repository_id"),
        "commit_id",
        F.col("upload_id").alias("identifier"),
        F.lit("INGESTION").alias("kind"),
        state.alias("state"),
        F.col("ingest_time").alias("event_time"),
        # Only settles the order of uploads of one moment.
        F.xxhash64("upload_id").alias("event_id"),
        F.col("ingest_time").alias("stored_time"),
    )


def decide(
    events: DataFrame,
    root: str,
    quiet: timedelta = QUIET_PERIOD,
    lifetime: timedelta = STATE_LIFETIME,
    wall_clock: bool = False,
) -> StreamingQuery:
    """Write what the state machine puts out for ``events`` to ``root``/decisions."""
    return (
        orchestrate(events, quiet, lifetime=lifetime, wall_clock=wall_clock)
        .writeStream.format("parquet")
        .option("path", f"{root}/decisions")
        .option("checkpointLocation", f"{root}/checkpoints/decisions")
        .trigger(availableNow=True)
        .start()
    )


def report_decided(spark: SparkSession, root: str, tables: Tables) -> StreamingQuery:
    """Write to ``root``/reports the report of every commit that became complete; a commit may become so again."""
    decisions = spark.readStream.schema(OUTPUT).parquet(f"{root}/decisions")
    finalised = decisions.filter(F.col("output") == "uploads_finalised").select(
        F.col("repository_id").alias("project_id"), "commit_id"
    )
    return coverage_stream(finalised, tables, f"{root}/reports", f"{root}/checkpoints/reports")


def latest_reports(spark: SparkSession, root: str) -> DataFrame:
    """Of each commit the report of its last micro-batch."""
    reports = spark.read.parquet(f"{root}/reports")
    columns = [c for c in reports.columns if c not in ("project_id", "commit_id", "batch")]
    newest = F.max_by(F.struct(*columns), "batch")
    return reports.groupBy("project_id", "commit_id").agg(newest.alias("r")).select("project_id", "commit_id", "r.*")
