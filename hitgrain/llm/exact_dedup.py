"""Exact dedup by content sort.

Normalised texts are dealt to ranges by sampled splitters (leading characters, then a hash of the whole text), an
external sort within each range puts equals next to each other, and comparing neighbours in full forms the groups.
Of equal texts the row with the largest identifier stays.

Scale: every text is shuffled once. The splitters are short keys, not texts. A text with more than ``HOT_SHARE`` of all
rows would fill one range, so such texts are found first by counting hashes and are combined before any shuffle;
there are at most ``1 / HOT_SHARE`` of them, which bounds what is broadcast (an identifier, a count and two hashes each).

Defined results: a null text counts as empty; equal means identical after lower-casing A-Z only. Null identifiers
rank below all others; a group of nulls only has a null ``keep_id``. Of rows that repeat the largest identifier of
their group exactly one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.llm.common import ROW, lower_ascii, text_or_empty, unwrapped, wrapped
from hitgrain.session import stage_table

HOT_SHARE = 1e-4
# Groups of so many rows are no burden for a task at any size.
HOT_ROWS = 1000
HEAD = 16


def label_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``row`` (the input row), ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    raw = text_or_empty(F.col(ROW)[text])
    norm = lower_ascii(raw)
    # Equal normalised texts are equal here too, and this is quicker than the normal form.
    rows = wrapped(docs).withColumn("_head", F.left(F.lower(raw), F.lit(HEAD))).withColumn("_hash", F.xxhash64(F.lower(raw)))
    limit = max(hot_rows, int(docs.count() * hot_share))
    crowded = rows.groupBy("_hash").count().filter(F.col("count") > limit).select("_hash")
    hot = (
        rows.join(F.broadcast(crowded), "_hash", "left_semi")
        .groupBy("_hash", norm.alias("_norm"))
        .agg(F.max(F.col(ROW)[doc_id]).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > limit)
        .select(F.col("_hash").alias("_hot_hash"), F.sha2("_norm", 256).alias("_hot_sha"), "keep_id", "group_size")
    )
    hot = F.broadcast(stage_table(hot, "hot-texts"))
    tagged = rows.join(hot, (F.col("_hash") == hot["_hot_hash"]) & (F.sha2(norm, 256) == hot["_hot_sha"]), "left")
    return _sorted_part(tagged.filter("group_size is null"), norm, doc_id).unionByName(
        _hot_part(tagged.filter("group_size is not null"), doc_id)
    )


def _sorted_part(rows: DataFrame, norm, doc_id: str) -> DataFrame:
    ranged = rows.select(ROW, "_head", "_hash").repartitionByRange("_head", "_hash").withColumn("_norm", norm)
    group = (
        Window.partitionBy("_head", "_hash", "_norm")
        .orderBy(F.col(ROW)[doc_id].desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    place = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.select(
        ROW,
        F.first(F.col(ROW)[doc_id]).over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(place) == 1).alias("kept"),
        F.sha2("_norm", 256).alias("text_sha256"),
    )


def _hot_part(rows: DataFrame, doc_id: str) -> DataFrame:
    """Rows of hot texts need no sort; only those with the largest identifier of their group may stay."""
    rows = rows.select(ROW, "keep_id", "group_size", F.col("_hot_sha").alias("text_sha256"))
    first = F.col(ROW)[doc_id].eqNullSafe(F.col("keep_id"))
    place = Window.partitionBy("text_sha256").orderBy("keep_id")
    return (
        rows.filter(~first)
        .withColumn("kept", F.lit(False))
        .unionByName(rows.filter(first).withColumn("kept", F.row_number().over(place) == 1))
    )


def unique_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return unwrapped(label_copies(docs, text, doc_id).filter("kept"))
