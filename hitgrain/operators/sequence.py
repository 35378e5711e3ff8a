"""Running values over long ordered groups, split into bounded chunks.

A plain window puts a whole group in one task. Here a group is cut by its
order column into chunks; windows run per (group, chunk), and only one summary
row per chunk goes through the window over the whole group. One report, commit
or job that holds a large share of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"


def with_chunk(df: DataFrame, order: Column, span: int) -> DataFrame:
    """Add the chunk number of each row: ``span`` neighbouring order values share a chunk."""
    return df.withColumn(CHUNK, F.call_function("div", order, F.lit(span)))


def chunk_window(keys: Sequence[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def earlier_chunks(keys: Sequence[str]) -> WindowSpec:
    """All chunks of the group before the current one."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def later_chunks(keys: Sequence[str]) -> WindowSpec:
    """All chunks of the group after the current one."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)


def carry(
    df: DataFrame, keys: Sequence[str], summaries: dict[str, Column], *steps: dict[str, Column], summarised: DataFrame | None = None
) -> DataFrame:
    """Attach to every row what the other chunks of its group contribute.

    ``summaries`` are aggregates per (group, chunk). Each step adds window
    expressions over those summaries, and the columns of all steps are joined
    back to the rows. Rows, summaries and windows share one partitioning.

    Where most groups have one chunk, ``summarised`` may hold only the rows of those with several (``of_several_chunks``);
    the columns are NULL in all other rows.
    """
    per_chunk = (df if summarised is None else summarised).groupBy(*keys, CHUNK).agg(*[agg.alias(name) for name, agg in summaries.items()])
    for step in steps:
        per_chunk = per_chunk.withColumns(step)
    return df.join(per_chunk.drop(*summaries), [*keys, CHUNK], "inner" if summarised is None else "left")


def of_several_chunks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of those groups that lie in more than one chunk. ``df`` is partitioned by group and chunk.

    The chunks are found with a count of every other column, so that they need the same columns of that shuffle as the rows
    do, and Spark reuses it; rows must be filtered before that shuffle. Each (group, chunk) is found once, so the join
    multiplies nothing; a semi-join would move below the shuffle.
    """
    counts = {f"n_{c}": F.count(c) for c in df.columns if c not in (*keys, CHUNK)}
    chunks = df.groupBy(*keys, CHUNK).agg(*[count.alias(name) for name, count in counts.items()])
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    found = chunks.withColumn("several", several)
    for name in counts:
        found = found.filter(F.col(name) >= 0)
    return df.join(found.filter("several").select(*keys, CHUNK), [*keys, CHUNK])
