"""URL filters: a sort-merge range join of reversed-host keys with nested rules.

A rule ``host/path`` fits its host, all subdomains, and every path that starts with its path. Its canonical key is
the reversed host, ``/`` and the path (``org.example//es/``), so everything below it is one interval of keys, and
intervals of two rules are nested or apart. A url asks one key for each host depth that some rule has. Rules and
asked keys are sorted together in ranges. A sweep along the keys holds the stack of the rule last begun; rules whose
interval has ended are popped, and the top of the stack is the innermost rule.

Scale: asked keys are distinct and end where the longest rule path ends (no rule can see further), so a host with a
third of all urls is a few keys before the first shuffle. Ranges come from Spark's sampled splitters; each range is
swept by itself and the open stack is handed over by one summary row per range.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the default verdict. Of
rules with equal keys, block wins. Of fitting rules the longest ``host + path`` wins, then the longer host. Rows that
repeat are judged each. An empty table gives an empty result; without rules all get the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitgrain.llm.common import ROW, lower_ascii, wrapped
from hitgrain.operators.sequence import CHUNK, carry, chunk_window, earlier_chunks
from hitgrain.session import stage_table

PARTS = r"(?s)://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules (``rule`` like ``example.org/es/``, ``verdict`` allow or block) with key and stack.

    The stack of a rule lists the rules whose intervals hold it, outermost first, itself last.
    """
    host = F.regexp_extract("rule", "^[^/]*", 0)
    own = (
        rules.filter("rule is not null and verdict is not null")
        .select(lower_ascii(host).alias("host"), F.regexp_extract("rule", "(?s)/.*$", 0).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", _key(F.split("host", r"\."), F.col("path")))
    )
    item = F.struct("key", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    own = own.withColumn("item", item)
    lengths = own.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths")).first()["lengths"]
    prefix = F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.left(F.col("key"), n))
    outer = own.select(F.col("key").alias("prefix"), F.col("item").alias("outer"))
    return (
        own.select("key", "host", "path", F.explode(F.array_distinct(prefix)).alias("prefix"))
        .join(outer, "prefix")
        .groupBy("key", "host", "path")
        .agg(F.sort_array(F.collect_list("outer")).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``row`` (the input row), ``host``, ``path``, ``rule`` and ``verdict`` of every row."""
    judged = wrapped(pages).withColumn("host", url_host(F.col(ROW)[url])).withColumn("path", url_path(F.col(ROW)[url]))
    stacks = stage_table(prepared_rules(rules), "url-rules")
    # Bounded by the longest rule, however many rules there are.
    reach = stacks.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("depths"), F.max(F.length("path")).alias("path")
    ).first()
    if not reach["depths"]:
        return judged.select(ROW, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = judged.withColumn("near", F.left("path", F.lit(reach["path"])))
    sites = judged.filter("host <> ''").select("host", "near").distinct()
    labels = F.split("host", r"\.")
    asked = F.array(
        *[
            F.when(F.size(labels) >= depth, _key(F.slice(labels, -depth, depth), F.col("near")))
            for depth in sorted(reach["depths"])
        ]
    )
    probes = sites.select("host", "near", F.explode(F.array_compact(asked)).alias("key"))
    events = stacks.select("key", "stack").unionByName(probes, allowMissingColumns=True)
    ranges = stage_table(
        events.repartitionByRange("key", "host", "near").withColumn(CHUNK, F.spark_partition_id()), "url-ranges"
    )
    # Nulls first: a rule stands before the probes that have its key.
    sweep = carry(
        ranges,
        [],
        {"_last": F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key")))},
        {"_before": F.last("_last", ignorenulls=True).over(earlier_chunks([]))},
    )
    begun = F.last("stack", ignorenulls=True).over(chunk_window([], F.col("key"), F.col("host").asc_nulls_first()))
    top = F.filter("open", lambda rule: F.startswith(F.col("key"), rule["key"]))
    best = (
        sweep.withColumn("open", F.coalesce(begun, "_before"))
        .filter("host is not null")
        .withColumn("top", F.try_element_at(top, F.lit(-1)))
        .filter("top is not null")
        .groupBy("host", "near")
        .agg(F.max_by("top", F.struct(F.length("top.rule"), "top.host_length")).alias("top"))
    )
    return judged.join(best, ["host", "near"], "left").select(
        ROW, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )
