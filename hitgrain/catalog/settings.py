"""Queries on repository settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.catalog import Query
from hitgrain.operators import settings as O
from hitgrain.sources import bind


def repository(number: Column) -> Column:
    return F.concat(F.lit("r"), F.floor(number / 3).cast("string"))


def setting_values(spark: SparkSession, d: str) -> DataFrame:
    """One configuration file per customer; every three customers share a repository."""
    customer = bind.table(spark, d, "customer")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    comment = (
        F.when(segment == "BUILDING", F.lit("annotation"))
        .when(segment == "HOUSEHOLD", F.lit("hidden"))
        .when(segment == "MACHINERY", F.lit("loud"))
    )
    default = F.concat(F.lit('{"carryforward":'), (F.col("c_acctbal") > 3000).cast("string"), F.lit("}"))
    nation = F.col("c_nationkey").cast("string")
    tags = F.when(
        F.col("c_nationkey") < 20,
        F.concat(
            F.lit('[{"name":"t'), nation, F.lit('","carryforward":true},{"name":"t'), nation,
            F.lit('","carryforward":false},{"name":"unit","carryforward":'), (key % 2 == 0).cast("string"), F.lit("}]"),
        ),
    ).otherwise(F.lit('[{"carryforward":true}]'))
    rules = F.when(key % 4 == 0, F.lit('[{"before":"^a/","after":"b/"}]')).when(
        key % 4 == 1, F.lit('[{"after":"b/"}]')
    )
    entries = F.array(
        F.struct(F.lit(O.LINE_COMMENT_TYPE).alias("key"), comment.alias("value")),
        F.struct(F.lit(O.DEFAULT_TAG_BEHAVIOUR).alias("key"), default.alias("value")),
        F.struct(F.lit(O.TAG_BEHAVIOURS).alias("key"), tags.alias("value")),
        F.struct(F.lit(O.PATH_REPLACEMENTS).alias("key"), rules.alias("value")),
        F.struct(F.lit("unknown.key").alias("key"), F.lit("1").alias("value")),
    )
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return customer.select(
        repository(key).alias("repository_id"), key.alias("event_time"), F.map_from_entries(present).alias("values")
    )


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Settings after all configuration files."""
    empty = spark.createDataFrame([], "repository_id string, key string, value string")
    return O.apply_settings_change(empty, setting_values(spark, d))


def q_apply_settings_change(spark: SparkSession, d: str) -> DataFrame:
    """Files of two nations in three were applied before; the rest change or add to them."""
    files = setting_values(spark, d)
    empty = spark.createDataFrame([], "repository_id string, key string, value string")
    before = O.apply_settings_change(empty, files.filter(~F.element_at("values", O.DEFAULT_TAG_BEHAVIOUR).contains("true")))
    return O.apply_settings_change(before, files.filter(F.element_at("values", O.DEFAULT_TAG_BEHAVIOUR).contains("true")))


def repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of all orders' customers, with or without settings, and some beyond."""
    return bind.table(spark, d, "orders").select(repository(F.col("o_custkey") * 2).alias("repository_id")).distinct()


def q_resolve_settings(spark: SparkSession, d: str) -> DataFrame:
    return O.resolve_settings(repositories(spark, d), stored(spark, d)).select(
        "repository_id",
        "line_comment_type",
        "carryforward_default",
        F.array_join(F.transform("tag_behaviours", lambda t: F.concat_ws("=", t["name"], t["carryforward"].cast("string"))), ",").alias("tag_behaviours"),
        F.array_join(F.transform("path_replacements", lambda r: F.concat_ws(">", r["before"], r["after"])), ",").alias("path_replacements"),
    )


def q_tag_carryforward_allowed(spark: SparkSession, d: str) -> DataFrame:
    resolved = O.resolve_settings(repositories(spark, d), stored(spark, d))
    nation = bind.table(spark, d, "customer").select(
        repository(F.col("c_custkey")).alias("repository_id"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("tag")
    )
    unit = repositories(spark, d).withColumn("tag", F.lit("unit"))
    return O.tag_carryforward_allowed(nation.unionByName(unit).distinct(), O.tag_settings(resolved))


QUERIES: dict[str, Query] = {
    "resolve_settings": q_resolve_settings,
    "tag_carryforward_allowed": q_tag_carryforward_allowed,
    "apply_settings_change": q_apply_settings_change,
}

_FILES = """file as (
  select concat('r', cast(c_custkey // 3 as varchar)) as repository_id, c_custkey as event_time, c_acctbal > 3000 as carries,
    case c_mktsegment when 'BUILDING' then 'annotation' when 'HOUSEHOLD' then 'hidden' end as comment,
    concat('{"carryforward":', case when c_acctbal > 3000 then 'true' else 'false' end, '}') as def,
    case when c_nationkey < 20 then concat('t', cast(c_nationkey as varchar)) end as own_tag,
    case when c_custkey % 2 = 0 then 'true' else 'false' end as unit,
    case when c_custkey % 4 = 0 then '[{"before":"^a/","after":"b/"}]' end as rules
  from customer)"""
_ROWS = """select repository_id, 'line_comment.type' as key, comment as value from {0} where comment is not null
  union all select repository_id, 'tag_behaviour.default', def from {0}
  union all select repository_id, 'tag_behaviour.tags', concat('[{{"name":"', own_tag, '","carryforward":true}},{{"name":"', own_tag,
    '","carryforward":false}},{{"name":"unit","carryforward":', unit, '}}]') from {0} where own_tag is not null
  union all select repository_id, 'path_replacements', rules from {0} where rules is not null"""
_NEWEST = "select * from (select *, row_number() over (partition by repository_id order by event_time desc) as r from {0}) where r = 1"
_REPOSITORIES = "repo as (select distinct concat('r', cast(o_custkey * 2 // 3 as varchar)) as repository_id from orders)"

ORACLES: dict[str, str] = {
    "apply_settings_change": f"""with {_FILES}, old as ({_NEWEST.format('(select * from file where not carries)')}),
      new as ({_NEWEST.format('(select * from file where carries)')}),
      kept as (select * from old where repository_id not in (select repository_id from new)),
      both_files as (select * from kept union all select * from new)
      {_ROWS.format('both_files')}""",
    "resolve_settings": f"""with {_FILES}, {_REPOSITORIES}, newest as ({_NEWEST.format('file')})
      select r.repository_id, coalesce(comment, 'review_comment') as line_comment_type, coalesce(carries, true) as carryforward_default,
        case when own_tag is not null then concat(own_tag, '=true,', own_tag, '=false,unit=', unit) else '' end as tag_behaviours,
        case when rules is not null then '^a/>b/' else '' end as path_replacements
      from repo r left join newest n on n.repository_id = r.repository_id""",
    "tag_carryforward_allowed": f"""with {_FILES}, {_REPOSITORIES}, newest as ({_NEWEST.format('file')}),
      tags as (select concat('r', cast(c_custkey // 3 as varchar)) as repository_id, concat('t', cast(c_nationkey as varchar)) as tag from customer
        union select repository_id, 'unit' from repo)
      select t.repository_id, t.tag,
        case when x.repository_id is null then true
             when own_tag is not null and t.tag = own_tag then true
             when own_tag is not null and t.tag = 'unit' then unit = 'true' else coalesce(carries, true) end as allowed
      from tags t left join repo x on x.repository_id = t.repository_id
      left join newest n on n.repository_id = t.repository_id and x.repository_id is not null""",
}
