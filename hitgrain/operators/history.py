"""Ancestors, carried-forward tags and base commits.

``history`` has one row per commit: ``project_id``, ``commit_id``, ``number`` in the order of the project's commits, ``parents``
(identifiers, the first parent first), ``merged`` and ``ref``. Only ancestors of a commit count for it, never commits of other branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.operators.ancestry import SPAN, ancestors_of, nearest_marked
from hitgrain.operators.coverage import WAYPOINT
from hitgrain.operators.settings import tag_carryforward_allowed
from hitgrain.operators.uploads import commit_tags, uploaded_tags, uploads_per_tag


def within(position: Column, max_position: int | None) -> Column:
    return F.lit(True) if max_position is None else position <= max_position


def commit_ancestors(history: DataFrame, heads: DataFrame, max_position: int | None = None, span: int = SPAN) -> DataFrame:
    """All ancestors of each head, the head excluded; ``position`` counts from it, newest first.

    The result is as large as the ancestors of all heads together, so this is for asking about some heads; the other operators do not use it.
    """
    position = F.row_number().over(Window.partitionBy("project_id", "head").orderBy(F.desc("ancestor")))
    found = ancestors_of(history, heads, span).withColumn("position", position).filter(within(F.col("position"), max_position))
    names = history.select("project_id", F.col("number").cast("long").alias("head"), F.col("commit_id").alias("_name"))
    details = history.select(
        "project_id", F.col("number").cast("long").alias("ancestor"), "commit_id", F.coalesce("merged", F.lit(True)).alias("merged"), "ref"
    )
    return (
        found.join(names, ["project_id", "head"])
        .join(details, ["project_id", "ancestor"])
        .select("project_id", F.col("_name").alias("head"), "position", F.col("commit_id").alias("ancestor"), "merged", "ref")
    )


def branch_tips(history: DataFrame) -> DataFrame:
    """Commits that are no commit's parent."""
    parents = history.select("project_id", F.explode("parents").alias("commit_id"))
    return history.select(*WAYPOINT).join(parents, list(WAYPOINT), "left_anti")


def tags_not_seen(known: DataFrame, existing: DataFrame) -> DataFrame:
    """Known (waypoint, tag) pairs without those the waypoint already has."""
    return known.join(existing, [*WAYPOINT, "tag"], "left_anti")


def carryforward_candidates(waypoints: DataFrame, uploads: DataFrame, tag_settings: DataFrame) -> DataFrame:
    """Tags of the project that the commit lacks and that settings allow to be carried forward."""
    known = uploaded_tags(uploads).withColumnRenamed("tag_name", "tag")
    allowed = tag_carryforward_allowed(
        known.withColumnRenamed("project_id", "repository_id"), tag_settings
    ).filter("allowed")
    allowed = allowed.select(F.col("repository_id").alias("project_id"), "tag")
    pairs = waypoints.select(*WAYPOINT).join(allowed, "project_id")
    return tags_not_seen(pairs, commit_tags(uploads))


def nearest_tag_commits(
    candidates: DataFrame, history: DataFrame, uploads: DataFrame, max_position: int | None = None, span: int = SPAN
) -> DataFrame:
    """Per (waypoint, tag) the newest ancestor that has the tag, however far back; ``position`` is how far their numbers lie apart."""
    marks = commit_tags(uploads).select(*WAYPOINT, F.col("tag").alias("kind"), F.lit(None).cast("string").alias("label"))
    wanted = candidates.select(*WAYPOINT, F.col("tag").alias("kind"))
    found = nearest_marked(history, marks, wanted, span)
    return found.select(
        *WAYPOINT,
        F.col("kind").alias("tag"),
        F.col("first_commit").alias("source_commit"),
        (F.col("number") - F.col("first_number")).alias("position"),
    ).filter(within(F.col("position"), max_position))


def carryforward_tags(
    candidates: DataFrame, history: DataFrame, uploads: DataFrame, max_position: int | None = None
) -> DataFrame:
    """Carried-forward tags, one row per upload of their source with its line count and ingest time."""
    nearest = nearest_tag_commits(candidates, history, uploads, max_position)
    sources = uploads_per_tag(uploads).withColumnRenamed("commit_id", "source_commit")
    return nearest.join(sources, ["project_id", "source_commit", "tag"]).select(
        *WAYPOINT, "tag", "source_commit", "upload_id", "successfully_uploaded_lines", "ingest_time"
    )


def tag_union(own: DataFrame, carried: DataFrame) -> DataFrame:
    """Own and carried-forward tags together, duplicates kept."""
    return own.unionByName(carried)


def base_commit_from_history(
    events: DataFrame, history: DataFrame, max_position: int | None = None, span: int = SPAN
) -> DataFrame:
    """Newest ancestor on another ref than the head, however far back; only for events that name a base ref."""
    heads = events.filter(F.col("base_ref").isNotNull()).select(*WAYPOINT, F.col("ref").alias("head_ref"), "base_ref")
    every = F.lit("commit").alias("kind")
    marks = history.select(*WAYPOINT, every, F.col("ref").alias("label"))
    found = nearest_marked(history, marks, heads.select(*WAYPOINT, every).distinct(), span)
    # If the newest ancestor is on the head's own ref, the newest one on another ref is the answer.
    same = F.col("first_label").eqNullSafe(F.col("head_ref"))
    picked = {
        name: F.when(same, F.col(f"second_{field}")).otherwise(F.col(f"first_{field}"))
        for name, field in (("_number", "number"), ("_commit", "commit"), ("_ref", "label"))
    }
    return (
        heads.join(found, list(WAYPOINT))
        .withColumns(picked)
        .filter(F.col("_commit").isNotNull() & within(F.col("number") - F.col("_number"), max_position))
        .select(*WAYPOINT, F.col("_commit").alias("base_commit"), F.coalesce("_ref", "base_ref").alias("base_ref"))
    )


def base_commit(events: DataFrame, history: DataFrame, max_position: int | None = None) -> DataFrame:
    """Base of the comparison: from history, else from the event's base, else its first parent."""
    found = base_commit_from_history(events, history, max_position).select(
        *WAYPOINT,
        F.struct(F.lit("history").alias("source"), "base_commit", "base_ref").alias("from_history"),
    )

    def choice(source: str, commit: Column, ref: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), commit.alias("base_commit"), ref.alias("base_ref"))

    has_base = F.col("pull_request").isNotNull() & F.col("base_ref").isNotNull() & F.col("base_commit").isNotNull()
    from_event = F.when(has_base, choice("event", F.col("base_commit"), F.col("base_ref")))
    from_parent = F.when(
        F.size("parent") > 0, choice("parent", F.get(F.col("parent"), F.lit(0)), F.col("ref"))
    )
    return (
        events.join(found, list(WAYPOINT), "left")
        .withColumn("base", F.coalesce("from_history", from_event, from_parent))
        .select(
            *WAYPOINT,
            F.col("base.base_commit").alias("base_commit"),
            F.col("base.base_ref").alias("base_ref"),
            F.coalesce(F.col("base.source"), F.lit("none")).alias("source"),
        )
    )


def comparable(head: str = "head", base: str = "base") -> Column:
    """Head and base must be of the same provider, owner and repository."""
    condition = F.lit(True)
    for column in ("provider", "owner", "repository"):
        condition = condition & (F.col(f"{head}.{column}") == F.col(f"{base}.{column}"))
    return condition
