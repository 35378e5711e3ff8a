"""Token ids as Parquet list columns.

Documents are dealt to ranges of ascending identifier and encoded in that order; Spark writes one list of ids per
document. Ids lie in a dictionary column, identifiers and positions are delta encoded, row groups and pages have
a set size, and the pages are indexed, so that a reader of few documents or of the metadata alone reads few pages.

Each document has its end id. ``part`` is the range a document lies in and ``place`` the ids before it in that range;
the ids of whole earlier ranges are added when the files are read.

Defined results: a null text is empty and has its end id only. Null identifiers come first. Rows that repeat are
documents each, in the order of their text hash. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitgrain.llm.common import give_back, stretches, text_or_empty
from hitgrain.llm.encoder import encoder
from hitgrain.session import work_dir

END = np.array([0], dtype="<u4").tobytes()
# Bytes of text that are encoded at a time.
BATCH = 3 << 20
SCHEMA = "doc_id long, part int, place long, n_tokens int, tokens array<int>"
LAYOUT = {
    "compression": "lz4_raw",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    # Pages of identifiers end here too, which makes their index fine enough for ranges of few documents.
    "parquet.page.row.count.limit": "256",
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{name}": "false" for name in ("doc_id", "part", "place", "n_tokens")},
}


def batches_of(batch: pa.RecordBatch, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    for at, to in stretches(batch["text"], size):
        yield batch.slice(at, to - at)


def _encoded(tokenizer: str):
    def encode(batches):
        place = 0
        for batch in (small for large in batches for small in batches_of(large)):
            ids, counts = encoder(tokenizer).encode_flat(batch["text"].to_pylist(), END)
            ends = counts.cumsum()
            values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["part"],
                    pa.array(place + ends - counts),
                    pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, values),
                ],
                names=["doc_id", "part", "place", "n_tokens", "tokens"],
            )
            place += int(ends[-1])
        give_back()

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write ids of all documents below ``path``, in ascending order over its files."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    ordered = (
        rows.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", F.spark_partition_id().alias("part"), "text")
    )
    ordered.mapInArrow(_encoded(tokenizer), SCHEMA).write.options(**LAYOUT).parquet(path)


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    # One row per range, as many as the shuffle had partitions.
    return stored.join(F.broadcast(parts), "part").withColumn("start", F.col("_base") + F.col("place"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``tokens``, read from the files.

    With ``first`` and ``last`` only of documents with identifiers between them, both included: the limits reach the files,
    whose row groups and pages hold ascending identifiers, so that pages of other documents are not read.
    """
    stored = _with_start(spark, path)
    if first is not None:
        stored = stored.filter(F.col("doc_id") >= first)
    if last is not None:
        stored = stored.filter(F.col("doc_id") <= last)
    return stored.select("doc_id", "start", "tokens")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` and ``n_tokens``; no page of ids is read."""
    return _with_start(spark, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"))


def _digested(batches):
    for batch in batches:
        lists = batch["tokens"]
        values = np.asarray(lists.flatten(), dtype="<u4")
        ends = np.asarray(lists.value_lengths()).astype(np.int64).cumsum()
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        held = memoryview(np.ascontiguousarray(values)).cast("B")
        crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], pa.array(ends - starts), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of what ``read_tokens`` gives."""
    return tokens.mapInArrow(_digested, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids to the shared folder and read them back."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
