"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. Complete epochs of the source come first. The rest is filled by documents in the
order of their exponential keys ``-ln(u) / weight``, where ``u`` comes from a hash of the document and ``weight`` is
its quality, up to the prefix sum that meets the budget most nearly.

Scale: keys are cut into ``SLICES`` slices. Sums per (source, slice) settle all slices but the one in which a
source's budget ends; only the documents of that slice are sorted and prefix-summed, so a source with a third of all
rows sorts about one row in ``SLICES``. Documents are read twice and otherwise not shuffled.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last in order. Rows
that repeat are documents each. Reruns agree, since keys depend on identifier, text and seed only. Budgets of sources
without words are 0. The table of sources (one row each) is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.llm.common import ROW, text_or_empty, unwrapped, word_count, wrapped
from hitgrain.session import stage_table

SLICES = 4096
MOST_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
# Letters of a prose word with its space.
PROSE = 6.0


def prose_weight(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: 1 where words are as long as in prose, less the further they are from it."""
    mean = F.length(text_or_empty(text)) / F.greatest(size, F.lit(1))
    return F.lit(PROSE) / (F.lit(PROSE) + F.abs(mean - F.lit(PROSE)))


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS
) -> DataFrame:
    """``target`` of each source of (``source``, ``source_size``).

    Sources in code point order take the weights in turn and share ``share`` of all words by them. A target stops at
    ``most`` times the source's size and the excess is shared again, until none is above: the level ``x`` is found for
    which ``min(most * size, x * weight)`` adds up to the budget.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(onwards)
    return (
        sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn))
        .withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_place", F.row_number().over(by_ratio))
        .withColumn("_level", level)
        .withColumn("_first", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level")))
        .withColumn("_level", F.min("_first").over(everything)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap"))))
        .select("source", "source_size", "target")
    )


def sample_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weight: Column | None = None,
    seed: int = 17,
    slices: int = SLICES,
    weights: Sequence[float] = WEIGHTS,
) -> DataFrame:
    """``row`` (the input row), ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes it)."""
    body = F.col(ROW)[text]
    if weight is None:
        weight = prose_weight(body, F.col("size"))
    digest = F.xxhash64(F.lit(seed), F.col(ROW)[doc_id], F.xxhash64(text_or_empty(body)))
    unit = (F.shiftrightunsigned(digest, 11) + 0.5) / F.lit(float(1 << 53))
    rows = (
        wrapped(docs)
        .withColumn("source", F.col(ROW)[source])
        .withColumn("size", word_count(body))
        .withColumn("_key", -F.log(unit) / weight)
        .withColumn("_slice", F.floor((1.0 - F.exp(-F.col("_key"))) * slices))
    )
    sums = stage_table(rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")), "slice-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights)
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    targets = targets.withColumn("_epochs", epochs).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size")
    )
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .join(targets.select(F.col("source").alias("_of"), "_rest"), F.col("source").eqNullSafe(F.col("_of")))
        .filter("_before < _rest and _rest <= _before + _sum")
        .select("_of", F.col("_slice").alias("_end_slice"), F.col("_before").alias("_end_before"))
    )
    plan = stage_table(
        targets.join(split, F.col("source").eqNullSafe(F.col("_of")), "left")
        .drop("_of")
        # Without such a slice the rest is nothing, or all that the source has.
        .withColumn("_end_slice", F.coalesce("_end_slice", F.when(F.col("_rest") > 0, slices + 1).otherwise(-1)))
        .withColumnRenamed("source", "_source"),
        "mix-plan",
    )
    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    settled = planned.filter(F.col("_slice") != F.col("_end_slice")).withColumn(
        "_taken", (F.col("_slice") < F.col("_end_slice")).cast("long")
    )
    ahead = (
        Window.partitionBy("source").orderBy("_key", F.col(ROW)[doc_id]).rowsBetween(Window.unboundedPreceding, -1)
    )
    prefix = F.coalesce(F.sum("size").over(ahead), F.lit(0)) + F.col("_end_before")
    ending = planned.filter(F.col("_slice") == F.col("_end_slice")).withColumn(
        "_taken", (prefix + F.col("size") / 2 <= F.col("_rest")).cast("long")
    )
    copies = F.when(F.col("size") > 0, F.col("_epochs") + F.col("_taken")).otherwise(F.lit(0))
    return settled.unionByName(ending).select(ROW, "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input."""
    taken = sample_mix(docs, **options).filter("copies > 0")
    return unwrapped(taken.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")))
