"""Provider webhooks to domain events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Used parts of the payloads, the null commit, the configuration path and main branches.
CHECK_RUN = (
    "repository struct<name:string,owner:struct<login:string>>,"
    "check_run struct<id:bigint,status:string,started_at:timestamp_ntz,completed_at:timestamp_ntz,"
    "app:struct<id:bigint>,check_suite:struct<head_branch:string,head_sha:string,before:string>,"
    "pull_requests:array<struct<number:bigint,base:struct<ref:string,sha:string>>>>"
)
PUSH = (
    "repository struct<name:string,owner:struct<login:string>>,ref string,after string,"
    "commits array<struct<id:string,timestamp:timestamp_ntz,added:array<string>,modified:array<string>,"
    "removed:array<string>>>"
)
NULL_COMMIT = "0" * 40
CONFIG_PATH = "coverage.yml"
BRANCH_PREFIX = "refs/heads/"
MAIN_REFS = ("main", "master")


def project_lookup(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events of known projects, with their project id."""
    return events.join(projects, ["provider", "owner", "repository"])


def webhook_job_state(payloads: DataFrame, projects: DataFrame) -> DataFrame:
    """Check-run payloads (column ``body``, JSON) to job state changes."""
    run = payloads.select(F.from_json("body", CHECK_RUN).alias("p")).select(
        F.lit("github").alias("provider"),
        F.col("p.repository.owner.login").alias("owner"),
        F.col("p.repository.name").alias("repository"),
        F.col("p.check_run.check_suite.head_branch").alias("ref"),
        F.col("p.check_run.check_suite.head_sha").alias("commit_id"),
        F.array_compact(
            F.array(F.nullif(F.col("p.check_run.check_suite.before"), F.lit(NULL_COMMIT)))
        ).alias("parent"),
        F.col("p.check_run.id").alias("external_id"),
        F.col("p.check_run.app.id").alias("triggered_by"),
        F.col("p.check_run.status").alias("state"),
        F.get("p.check_run.pull_requests", F.lit(0)).alias("pr"),
        F.coalesce("p.check_run.completed_at", "p.check_run.started_at").alias("event_time"),
    )
    flat = run.select(
        "*",
        F.col("pr.number").alias("pull_request"),
        F.col("pr.base.ref").alias("base_ref"),
        F.col("pr.base.sha").alias("base_commit"),
    ).drop("pr")
    return project_lookup(flat, projects)


def changed_files_union(commits: Column) -> Column:
    """All files added, modified or removed by an array of pushed commits."""
    empty = F.array().cast("array<string>")
    return F.flatten(
        F.transform(
            commits,
            lambda c: F.concat(*[F.coalesce(c[part], empty) for part in ("added", "modified", "removed")]),
        )
    )


def webhook_config_change(payloads: DataFrame, projects: DataFrame, config_path: str = CONFIG_PATH) -> DataFrame:
    """Push payloads to configuration changes.

    Kept are pushes to a branch that touch the configuration file and have
    exactly one head commit.
    """
    push = payloads.select(F.from_json("body", PUSH).alias("p")).select("p.*")
    heads = F.filter("commits", lambda c: c["id"] == F.col("after"))
    kept = push.filter(
        F.startswith("ref", F.lit(BRANCH_PREFIX))
        & F.array_contains(changed_files_union(F.col("commits")), config_path)
        & (F.size(heads) == 1)
    )
    rows = kept.select(
        F.lit("github").alias("provider"),
        F.col("repository.owner.login").alias("owner"),
        F.col("repository.name").alias("repository"),
        F.substr("ref", F.lit(len(BRANCH_PREFIX) + 1)).alias("ref"),
        F.col("after").alias("commit_id"),
        F.array_max(F.transform("commits", lambda c: c["timestamp"])).alias("event_time"),
    )
    return project_lookup(rows, projects)


def main_branch_changes(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("ref").isin(*MAIN_REFS))
