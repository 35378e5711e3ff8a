"""De-duplication of publishable messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_message_per_group(messages: DataFrame) -> DataFrame:
    """Keep the newest collection of every group, then give its messages one by one.

    ``messages`` is (message_group, seq, messages array<struct<valid_until, payload>>).
    A collection is valid until the latest of its messages; on a tie the one
    that came first stays. A maximum per group combines before the shuffle, so
    a busy group does not gather in one task.
    """
    valid_until = F.array_max(F.transform("messages", lambda m: m["valid_until"]))
    ranked = messages.filter(F.col("message_group").isNotNull()).withColumn("valid_until", valid_until)
    newest = ranked.groupBy("message_group").agg(
        F.max_by("messages", F.struct("valid_until", -F.col("seq"))).alias("messages")
    )
    return newest.select(
        "message_group", F.posexplode("messages").alias("position", "message")
    ).select("message_group", "position", "message.valid_until", "message.payload")
