"""Domain events as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event names, and the fields shared by their JSON bodies.
EVENT_TYPES = (
    "INGEST_STARTED",
    "INGEST_SUCCESS",
    "INGEST_FAILURE",
    "JOB_STATE_CHANGE",
    "UPLOADS_STARTED",
    "UPLOADS_FINALISED",
    "COVERAGE_FINALISED",
    "COVERAGE_FAILED",
    "CONFIGURATION_FILE_CHANGE",
    "UPLOAD",
    "UTILISATION_AMENDMENT",
)
EVENT_FIELDS = (
    "type string, provider string, projectId string, owner string, repository string, ref string, commit string,"
    "parent array<string>, uploadId string, externalId string, triggeredByExternalId string, state string,"
    "pullRequest string, baseCommit string, baseRef string, coveragePercentage double, eventTime timestamp_ntz"
)
RENAMED = {
    "projectId": "project_id",
    "commit": "commit_id",
    "uploadId": "upload_id",
    "externalId": "external_id",
    "triggeredByExternalId": "triggered_by",
    "pullRequest": "pull_request",
    "baseCommit": "base_commit",
    "baseRef": "base_ref",
    "coveragePercentage": "coverage_percentage",
    "eventTime": "event_time",
}


def parse_events(raw: DataFrame, body: str = "value") -> DataFrame:
    """JSON bodies to typed columns; bodies that are no known event are dropped."""
    parsed = raw.select(F.from_json(body, EVENT_FIELDS).alias("e")).select("e.*")
    return parsed.withColumnsRenamed(RENAMED).filter(F.col("type").isin(*EVENT_TYPES))


def scan_events(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """Stream of domain events from a folder of JSON lines."""
    raw = spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(directory)
    return parse_events(raw)


def of_type(events: DataFrame, *names: str) -> DataFrame:
    return events.filter(F.col("type").isin(*names))


def orchestrated_identifier(kind: Column, project: Column, commit: Column, subject: Column) -> Column:
    """Identity of an orchestrated event: one per job, upload or finalised commit."""
    return F.concat_ws("#", F.initcap(kind), F.md5(F.concat_ws("", project, commit, subject)))
