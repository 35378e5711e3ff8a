"""Repository settings: defaults, tag behaviour and changes by configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Setting keys, the accepted comment types and the defaults.
LINE_COMMENT_TYPE = "line_comment.type"
PATH_REPLACEMENTS = "path_replacements"
DEFAULT_TAG_BEHAVIOUR = "tag_behaviour.default"
TAG_BEHAVIOURS = "tag_behaviour.tags"
SETTING_KEYS = (LINE_COMMENT_TYPE, PATH_REPLACEMENTS, DEFAULT_TAG_BEHAVIOUR, TAG_BEHAVIOURS)
COMMENT_TYPES = ("review_comment", "annotation", "hidden")
DEFAULT_COMMENT_TYPE = "review_comment"
DEFAULT_CARRYFORWARD = True

REPLACEMENTS_TYPE = "array<struct<before:string,after:string>>"
DEFAULT_BEHAVIOUR_TYPE = "struct<carryforward:boolean>"
BEHAVIOURS_TYPE = "array<struct<name:string,carryforward:boolean>>"


def valid_setting(key: Column, value: Column) -> Column:
    """Whether a stored or submitted value can be used; anything else counts as absent."""
    comment = (key == LINE_COMMENT_TYPE) & value.isin(*COMMENT_TYPES)
    rules = F.from_json(value, REPLACEMENTS_TYPE)
    replacements = (key == PATH_REPLACEMENTS) & F.forall(
        rules, lambda rule: rule["before"].isNotNull() & (rule["before"] != "")
    )
    default = (key == DEFAULT_TAG_BEHAVIOUR) & F.from_json(value, DEFAULT_BEHAVIOUR_TYPE)["carryforward"].isNotNull()
    tags = (key == TAG_BEHAVIOURS) & F.forall(
        F.from_json(value, BEHAVIOURS_TYPE),
        lambda tag: tag["name"].isNotNull() & tag["carryforward"].isNotNull(),
    )
    return F.coalesce(comment | replacements | default | tags, F.lit(False))


def resolve_settings(repositories: DataFrame, settings: DataFrame) -> DataFrame:
    """The four settings of every repository, stored or default.

    ``settings`` is (repository_id, key, value), one row per repository and key.
    """

    def stored(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value")))

    valid = settings.filter(valid_setting(F.col("key"), F.col("value")))
    per_repository = valid.groupBy("repository_id").agg(
        stored(LINE_COMMENT_TYPE).alias("line_comment_type"),
        F.from_json(stored(PATH_REPLACEMENTS), REPLACEMENTS_TYPE).alias("path_replacements"),
        F.from_json(stored(DEFAULT_TAG_BEHAVIOUR), DEFAULT_BEHAVIOUR_TYPE)["carryforward"].alias(
            "carryforward_default"
        ),
        F.from_json(stored(TAG_BEHAVIOURS), BEHAVIOURS_TYPE).alias("tag_behaviours"),
    )
    return (
        repositories.select("repository_id")
        .join(per_repository, "repository_id", "left")
        .select(
            "repository_id",
            F.coalesce("line_comment_type", F.lit(DEFAULT_COMMENT_TYPE)).alias("line_comment_type"),
            F.coalesce("path_replacements", F.array().cast(REPLACEMENTS_TYPE)).alias("path_replacements"),
            F.coalesce("carryforward_default", F.lit(DEFAULT_CARRYFORWARD)).alias("carryforward_default"),
            F.coalesce("tag_behaviours", F.array().cast(BEHAVIOURS_TYPE)).alias("tag_behaviours"),
        )
    )


def tag_settings(resolved: DataFrame) -> DataFrame:
    """Flat tag behaviour of resolved settings: default rows have a NULL tag, the first rule of a tag wins."""
    default = resolved.select(
        "repository_id", F.lit(None).cast("string").alias("tag"), F.col("carryforward_default").alias("carryforward")
    )
    rules = resolved.select("repository_id", F.posexplode("tag_behaviours").alias("rule_no", "rule"))
    first = (
        rules.groupBy("repository_id", F.col("rule.name").alias("tag"))
        .agg(F.min_by("rule.carryforward", "rule_no").alias("carryforward"))
    )
    return default.unionByName(first)


def tag_carryforward_allowed(tags: DataFrame, settings: DataFrame) -> DataFrame:
    """Per (repository, tag): the tag's own rule, else the repository default, else allowed.

    ``settings`` is the output of ``tag_settings``.
    """
    own = settings.filter(F.col("tag").isNotNull()).withColumnRenamed("carryforward", "own_rule")
    default = settings.filter(F.col("tag").isNull()).select(
        "repository_id", F.col("carryforward").alias("default_rule")
    )
    return (
        tags.select("repository_id", "tag")
        .join(own, ["repository_id", "tag"], "left")
        .join(default, "repository_id", "left")
        .select(
            "repository_id",
            "tag",
            F.coalesce("own_rule", "default_rule", F.lit(DEFAULT_CARRYFORWARD)).alias("allowed"),
        )
    )


def apply_settings_change(settings: DataFrame, files: DataFrame) -> DataFrame:
    """Settings after configuration files were applied.

    ``files`` is (repository_id, event_time, values map<string,string>). The
    newest file of a repository replaces all its settings; repositories without
    a file keep theirs.
    """
    newest = files.groupBy("repository_id").agg(F.max_by("values", "event_time").alias("values"))
    kept = settings.join(newest.select("repository_id"), "repository_id", "left_anti")
    written = (
        newest.select("repository_id", F.explode("values").alias("key", "value"))
        .filter(F.col("key").isin(*SETTING_KEYS) & valid_setting(F.col("key"), F.col("value")))
    )
    return kept.select("repository_id", "key", "value").unionByName(written)
