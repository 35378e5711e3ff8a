"""Expressions on coverage lines: type flags, metadata access, states and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line types and line states as stored in the tables.
METHOD, BRANCH, STATEMENT = "METHOD", "BRANCH", "STATEMENT"
COVERED, PARTIAL, UNCOVERED = "covered", "partial", "uncovered"


def flag_line_types(line_type: Column) -> list[Column]:
    """``contains_method``, ``contains_branch`` and ``contains_statement`` of one stored line."""
    return [
        (line_type == METHOD).alias("contains_method"),
        (line_type == BRANCH).alias("contains_branch"),
        (line_type == STATEMENT).alias("contains_statement"),
    ]


def metadata_value(metadata: Column, key: str) -> Column:
    """Value of the first entry with this key, NULL when there is none.

    The place is looked up among the keys, which is compiled code; a lambda over the entries is not.
    """
    return F.get(metadata["value"], (F.array_position(metadata["key"], key) - 1).cast("int"))


def extract_line_hits(metadata: Column) -> Column:
    """``lineHits`` as a number: an empty value is 0, a missing key is NULL."""
    value = metadata_value(metadata, "lineHits")
    return F.when(value == "", F.lit(0).cast("bigint")).when(value.isNotNull(), value.try_cast("bigint"))


def extract_branch_hits(metadata: Column) -> Column:
    """``branchHits`` as an array in stored order; an object or a missing key gives an empty array."""
    parsed = F.from_json(metadata_value(metadata, "branchHits"), "array<bigint>")
    return F.coalesce(parsed, F.array().cast("array<bigint>"))


def encode_metadata(
    line_type: Column, line_number: Column, hits: Column, branch_json: Column, name: Column
) -> Column:
    """The stored key/value list of a line. Every value is text; NULL becomes an empty string."""

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.coalesce(value.cast("string"), F.lit("")).alias("value"))

    common = [entry("type", line_type), entry("lineNumber", line_number), entry("lineHits", hits)]
    return (
        F.when(line_type == BRANCH, F.array(*common, entry("branchHits", branch_json)))
        .when(line_type == METHOD, F.array(*common, entry("name", name)))
        .otherwise(F.array(*common))
    )


def branch_hits_json(pairs: Column) -> Column:
    """JSON text of (branch number, hits) pairs in first-seen order.

    Numbers 0..n-1 in order make a JSON list; anything else makes an object.
    """
    is_list = F.transform(pairs, lambda p: p["branch"].cast("int")) == F.when(
        F.size(pairs) > 0, F.sequence(F.lit(0), F.size(pairs) - 1)
    )
    as_list = F.array_join(F.transform(pairs, lambda p: p["hits"].cast("string")), ",")
    as_object = F.array_join(
        F.transform(pairs, lambda p: F.concat(F.lit('"'), p["branch"].cast("string"), F.lit('":'), p["hits"].cast("string"))),
        ",",
    )
    return F.when(is_list, F.concat(F.lit("["), as_list, F.lit("]"))).otherwise(
        F.concat(F.lit("{"), as_object, F.lit("}"))
    )


def classify_line_state(sum_hits: Column, covered_branches: Column, all_branches_hit: Column) -> Column:
    """Three-way line state. A NULL condition falls through, so a line without any hits data is covered."""
    return (
        F.when((sum_hits == 0) & (covered_branches == 0), F.lit(UNCOVERED))
        .when(~all_branches_hit, F.lit(PARTIAL))
        .otherwise(F.lit(COVERED))
    )


def line_type_set(contains_method: Column, contains_branch: Column, contains_statement: Column) -> Column:
    """The types of a line as an ordered array."""
    return F.array_compact(
        F.array(
            F.when(contains_method, F.lit(METHOD)),
            F.when(contains_branch, F.lit(BRANCH)),
            F.when(contains_statement, F.lit(STATEMENT)),
        )
    )


def percentage(part: Column, total: Column) -> Column:
    """Unrounded percentage; no lines count as zero percent."""
    divisor = F.when(total == 0, F.lit(1)).otherwise(total)
    return part.cast("double") / divisor.cast("double") * F.lit(100.0)


def percentage_2dp(part: Column, total: Column) -> Column:
    """Percentage rounded half up to two places, in whole numbers so that ties are exact."""
    cents = F.call_function("div", F.lit(20000) * part + total, F.lit(2) * total)
    return cents.cast("double") / F.lit(100.0)


def round_2dp(value: Column) -> Column:
    """Round a signed double half away from zero to two places (never minus zero)."""
    return F.signum(value) * F.floor(F.abs(value) * 100 + F.lit(0.5)).cast("double") / F.lit(100.0) + F.lit(0.0)


def clamp_generated_at(epoch: Column, now_epoch: Column) -> Column:
    """Report time in seconds: values above now are milliseconds, and nothing lies in the future."""
    seconds = F.when(epoch > now_epoch, epoch.cast("double") / F.lit(1000.0)).otherwise(epoch.cast("double"))
    return F.least(now_epoch.cast("double"), seconds)
