"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgrain.session import stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of (``a``, ``b``).

    Each step takes minima per node, which combine before their shuffle, and joins them back, so a node with very
    many links is a skewed join side and not one task's work. Steps are written to the shared folder. The number of
    steps grows with the logarithm of the longest path.
    """
    pairs = stage_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        # Larger neighbours of each node go to its smallest neighbour.
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stage_table(large.filter("u <> v").distinct(), "links")
        # Every node and its smaller neighbours go to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(small, "u")
        pairs = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            joined.select("u", F.col("low").alias("v"))
        )
        pairs = stage_table(pairs.filter("u <> v").distinct(), "links")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
