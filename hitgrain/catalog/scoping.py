"""Queries on scopes, ancestors, carry-forward and base commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.catalog import Query
from hitgrain.catalog import sql as S
from hitgrain.catalog.coverage import FLAGS, W, joined
from hitgrain.operators import history as H
from hitgrain.operators import scope, uploads
from hitgrain.plans.reports import report_scope
from hitgrain.sources import bind

SPARSE = bind.SPARSE
SCOPE_COLUMNS = [*W, "upload_id", "tag", "source_commit"]


def sparse(spark: SparkSession, d: str, sizes: bool = False) -> DataFrame:
    return bind.uploads(spark, d, SPARSE, sizes)


def commits(spark: SparkSession, d: str) -> DataFrame:
    return bind.waypoints(spark, d, SPARSE)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return H.carryforward_candidates(commits(spark, d), sparse(spark, d), bind.tag_settings(spark, d))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    return H.nearest_tag_commits(candidates(spark, d), bind.history(spark, d), sparse(spark, d))


def whole_scope(spark: SparkSession, d: str, sizes: bool = False) -> DataFrame:
    return report_scope(
        commits(spark, d), sparse(spark, d, sizes), bind.history(spark, d), bind.tag_settings(spark, d)
    )


def q_carryforward_tags(spark: SparkSession, d: str) -> DataFrame:
    up = sparse(spark, d, sizes=True)
    return H.carryforward_tags(candidates(spark, d), bind.history(spark, d), up)


def q_scope_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the days on which open orders came in."""
    up = bind.uploads(spark, d).withColumn("ingest_date", F.to_date("ingest_time"))
    rows = bind.lines(spark, d).join(up.select("upload_id", "ingest_date"), "upload_id")
    days = (
        bind.table(spark, d, "orders")
        .filter(F.col("o_orderstatus") == "O")
        .select(F.to_date("o_orderdate").alias("ingest_date"))
    )
    return scope.scope_partitions(rows, days).select(
        F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"), "upload_id", "file_name", "line_number", "type", "hits"
    )


def q_partition_union(spark: SparkSession, d: str) -> DataFrame:
    own = scope.scope_uploads(sparse(spark, d), commits(spark, d))
    carried = scope.scope_carryforward(sparse(spark, d), nearest(spark, d))
    return scope.partition_union(own, carried).select(
        *W, F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date")
    )


def q_tag_union(spark: SparkSession, d: str) -> DataFrame:
    own = uploads.commit_tags(sparse(spark, d)).withColumn("source_commit", F.col("commit_id"))
    return H.tag_union(own, nearest(spark, d).select(*W, "tag", "source_commit"))


def q_tags_not_seen(spark: SparkSession, d: str) -> DataFrame:
    known = uploads.uploaded_tags(sparse(spark, d)).withColumnRenamed("tag_name", "tag")
    pairs = commits(spark, d).select(*W).join(known, "project_id")
    return H.tags_not_seen(pairs, uploads.commit_tags(sparse(spark, d)))


def q_comparable_check(spark: SparkSession, d: str) -> DataFrame:
    """Heads and their bases with repository fields from the tables; only comparable pairs stay."""
    def described(prefix: str) -> DataFrame:
        return commits(spark, d).select(
            "project_id",
            F.col("commit_id").alias(prefix),
            F.struct(
                F.lit("github").alias("provider"),
                F.concat(F.lit("o"), (F.col("commit_no") % 3).cast("string")).alias("owner"),
                F.col("project_id").alias("repository"),
            ).alias("head" if prefix == "commit_id" else "base"),
        )

    bases = H.base_commit(bind.finalised_events(spark, d), bind.history(spark, d))
    pairs = bases.join(described("commit_id"), W).join(described("base_commit"), ["project_id", "base_commit"])
    return pairs.filter(H.comparable()).select(*W, "base_commit")


QUERIES: dict[str, Query] = {
    "scope_uploads": lambda s, d: scope.scope_uploads(sparse(s, d), commits(s, d)).select(*SCOPE_COLUMNS),
    "scope_carryforward": lambda s, d: scope.scope_carryforward(sparse(s, d), nearest(s, d)).select(*SCOPE_COLUMNS),
    "scope_uploads_or_carryforward": lambda s, d: scope.scope_uploads_or_carryforward(
        sparse(s, d), commits(s, d), nearest(s, d)
    ).select(*SCOPE_COLUMNS),
    "scope_union": lambda s, d: scope.scope_union(
        scope.scope_uploads(sparse(s, d), commits(s, d)), scope.scope_carryforward(sparse(s, d), nearest(s, d))
    ).select(*SCOPE_COLUMNS),
    "scope_partitions": q_scope_partitions,
    "partition_union": q_partition_union,
    "scope_diff_lines": lambda s, d: scope.scope_diff_lines(joined(s, d), bind.diff(s, d)).select(
        *W, "upload_id", "file_name", "line_number", *FLAGS, "hits"
    ),
    "commit_ancestors": lambda s, d: H.commit_ancestors(bind.history(s, d), H.branch_tips(bind.history(s, d))),
    "tags_not_seen": q_tags_not_seen,
    "carryforward_candidates": candidates,
    "carryforward_tags": q_carryforward_tags,
    "tag_union": q_tag_union,
    "base_commit_from_history": lambda s, d: H.base_commit_from_history(
        bind.finalised_events(s, d), bind.history(s, d)
    ),
    "base_commit": lambda s, d: H.base_commit(bind.finalised_events(s, d), bind.history(s, d)),
    "comparable_check": q_comparable_check,
}

_SCOPE = "project_id, commit_id, upload_id, tag, source_commit"
_TIME = "strftime(u.ingest_time, '%Y-%m-%d %H:%M:%S')"
_BASE_HISTORY = """
  select e.project_id, e.commit_id, arg_min(h.ancestor, h.position) as base_commit,
    arg_min(coalesce(h.ref, e.base_ref), h.position) as base_ref
  from finalised_event e join history h on h.project_id = e.project_id and h.head = e.commit_id
  where e.base_ref is not null and h.ref is distinct from e.ref
  group by e.project_id, e.commit_id"""
S.BLOCKS["base_history"] = _BASE_HISTORY
S.BLOCKS["base_choice"] = """
  select e.project_id, e.commit_id,
    case when b.base_commit is not null then b.base_commit
         when e.pull_request is not null and e.base_ref is not null and e.base_commit is not null then e.base_commit
         else e.first_parent end as base_commit,
    case when b.base_commit is not null then b.base_ref
         when e.pull_request is not null and e.base_ref is not null and e.base_commit is not null then e.base_ref
         when e.first_parent is not null then e.ref end as base_ref,
    case when b.base_commit is not null then 'history'
         when e.pull_request is not null and e.base_ref is not null and e.base_commit is not null then 'event'
         when e.first_parent is not null then 'parent' else 'none' end as source
  from finalised_event e left join base_history b on b.project_id = e.project_id and b.commit_id = e.commit_id"""

ORACLES: dict[str, str] = {
    "scope_uploads": S.query(
        "select project_id, commit_id, upload_id, tag, commit_id as source_commit from upload_sparse"
    ),
    "scope_carryforward": S.query(
        """select c.project_id, c.commit_id, u.upload_id, u.tag, c.source_commit
        from carried c join upload_sparse u
          on u.project_id = c.project_id and u.commit_id = c.source_commit and u.tag = c.tag"""
    ),
    "scope_uploads_or_carryforward": S.query(f"select {_SCOPE} from scope_sparse"),
    "scope_union": S.query(
        f"select {_SCOPE} from scope_sparse"
    ),
    "scope_partitions": S.query(
        """select strftime(u.ingest_time, '%Y-%m-%d') as ingest_date, l.upload_id, l.file_name, l.line_number, l.type, l.hits
        from line_cov l join upload u on u.upload_id = l.upload_id
        where cast(u.ingest_time as date) in (select cast(o_orderdate as date) from orders where o_orderstatus = 'O')"""
    ),
    "partition_union": S.query(
        """select distinct project_id, commit_id, strftime(ingest_date, '%Y-%m-%d') as ingest_date from scope_sparse"""
    ),
    "scope_diff_lines": S.query(
        """select n.project_id, n.commit_id, n.upload_id, n.file_name, n.line_number, n.contains_method,
          n.contains_branch, n.contains_statement, n.hits
        from unnested n where exists (select 1 from diff d where d.project_id = n.project_id
          and d.commit_id = n.commit_id and d.file_name = n.file_name and d.line_number = n.line_number)"""
    ),
    "commit_ancestors": S.query(
        """select project_id, head, cast(row_number() over (partition by project_id, head order by position) as integer) as position,
          ancestor, coalesce(merged, true) as merged, ref
        from history h where not exists (select 1 from history c where c.project_id = h.project_id and c.ancestor = h.head)"""
    ),
    "tags_not_seen": S.query(
        """select w.project_id, w.commit_id, k.tag
        from waypoint_sparse w join (select distinct project_id, tag from upload_sparse) k on k.project_id = w.project_id
        except select project_id, commit_id, tag from upload_sparse"""
    ),
    "carryforward_candidates": S.query("select project_id, commit_id, tag from candidate"),
    "carryforward_tags": S.query(
        f"""select c.project_id, c.commit_id, c.tag, c.source_commit, u.upload_id,
          u.total_lines as successfully_uploaded_lines, {_TIME} as ingest_time
        from carried c join upload_sparse u
          on u.project_id = c.project_id and u.commit_id = c.source_commit and u.tag = c.tag"""
    ),
    "tag_union": S.query(
        """select distinct project_id, commit_id, tag, commit_id as source_commit from upload_sparse
        union all select project_id, commit_id, tag, source_commit from carried"""
    ),
    "base_commit_from_history": S.query("select project_id, commit_id, base_commit, base_ref from base_history"),
    "base_commit": S.query("select project_id, commit_id, base_commit, base_ref, source from base_choice"),
    "comparable_check": S.query(
        """select b.project_id, b.commit_id, b.base_commit from base_choice b
        join waypoint_sparse h on h.project_id = b.project_id and h.commit_id = b.commit_id
        join waypoint_sparse w on w.project_id = b.project_id and w.commit_id = b.base_commit
        where h.commit_no % 3 = w.commit_no % 3"""
    ),
}
