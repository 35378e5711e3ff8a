"""Packing documents into windows by non-negative least squares over the length histogram.

Documents are encoded and cut: full windows stand alone, and what is left of each document is one shorter piece. The
histogram of these lengths has fewer bins than the window has tokens, however large the corpus. Shallow combinations
(pairs, and triples whose shortest length lies on a grid) that fill a window exactly are enumerated; non-negative
least squares finds how often to repeat each; the counts are rounded down, and what remains is packed greedily, longest
first with the best fit, again on counts.

Every piece has a rank among the pieces of its length, and every slot of the solution takes a range of ranks. So a
join with the bounded table of slots places all pieces at once.

Scale: texts are not shuffled. Ranks are counters of each encoding task plus the counts of earlier tasks. The driver
sees one number per length; the table of slots is bounded by the window size, not by the corpus.

Defined results: a null text is empty and is a piece of its end id only. Rows that repeat are documents each. An
empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgrain.llm.common import give_back, text_or_empty
from hitgrain.llm.encoder import encoder
from hitgrain.llm.token_output import END, batches_of
from hitgrain.session import stage_table

WINDOW = 1024
# Shortest lengths of the triples are multiples of WINDOW / GRID.
GRID = 16
ROUNDS = 400
# Bytes of text that are encoded at a time, and stretches that the encoder remembers.
BATCH = 1 << 20
KEEP = 250_000
# A piece, the task that cut it and its rank among the task's pieces of that length.
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, rank long"


def _cut(tokenizer: str, window: int):
    def cut(batches):
        task, ranks = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        for batch in (small for large in batches for small in batches_of(large, BATCH)):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder(tokenizer, KEEP).encode(batch["text"].to_pylist(), END), strict=True):
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    rows.append((doc, start, length, zlib.crc32(piece), total, task, int(ranks[length])))
                    ranks[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)],
                names=[part.split()[0] for part in PIECES.split(", ")],
            )
        give_back()

    return cut


_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())


def combinations(window: int, grid: int = GRID) -> np.ndarray:
    """Rows (a, b, c) of lengths that fill the window exactly; a is 0 in pairs."""
    found = []
    for a in range(0, window // 3 + 1, max(1, window // grid)):
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def solve_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats of each combination, not negative, whose lengths come nearest to the histogram in squares.

    Accelerated projected gradient; the step is one over a bound of the largest eigenvalue.
    """
    used = combos > 0
    hist = histogram.astype(float)
    spread = np.bincount(combos[used], minlength=len(hist))
    step = 1.0 / (3.0 * spread.max())
    x = np.zeros(len(combos))
    y, momentum = x, 1.0
    for _ in range(rounds):
        made = sum(np.bincount(combos[:, k], weights=y, minlength=len(hist)) for k in range(combos.shape[1]))
        short = made - hist
        short[0] = 0.0
        stepped = np.maximum(0.0, y - step * short[combos].sum(axis=1))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = stepped + (momentum - 1) / following * (stepped - x)
        x, momentum = stepped, following
    return x


def plan_slots(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, first sequence, pieces per sequence, offset) that hold all pieces.

    ``histogram[n]`` counts the pieces of length n, below the window. Sequences are numbered from 0.
    """
    left = histogram.astype(np.int64).copy()
    done = np.zeros_like(left)
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def place(lengths: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, many in lengths:
            first = int(done[length])
            slots.append((length, first, first + times * many, sequence, many, offset))
            done[length] += times * many
            left[length] -= times * many
            offset += length * many
        sequence += times

    combos = combinations(window)
    counts = np.floor(solve_counts(left, combos) + 1e-6).astype(np.int64)
    for k in np.flatnonzero(counts):
        lengths, many = np.unique(combos[k][combos[k] > 0], return_counts=True)
        times = min(int(counts[k]), *(int(left[n] // m) for n, m in zip(lengths, many, strict=True)))
        if times > 0:
            place(list(zip(lengths.tolist(), many.tolist(), strict=True)), times)
    while left.any():
        free, pattern = window, {}
        while True:
            fits = np.flatnonzero(left[: free + 1])
            fits = [n for n in fits[::-1].tolist() if left[n] > pattern.get(n, 0)][:1]
            if not fits:
                break
            many = min(free // fits[0], int(left[fits[0]]) - pattern.get(fits[0], 0))
            pattern[fits[0]] = pattern.get(fits[0], 0) + many
            free -= many * fits[0]
        place(list(pattern.items()), min(int(left[n] // m) for n, m in pattern.items()))
    return slots


def pack_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    pieces = stage_table(rows.mapInArrow(_cut(tokenizer, window), PIECES), "pieces")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage_table(
        pieces.groupBy("length", "task")
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0))),
        "piece-counts",
    )
    # One number per length, so at most ``window`` rows.
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, count in counts.groupBy("length").agg(F.sum("_count")).collect():
        histogram[length] = count
    slots = plan_slots(histogram[:window], window)
    sequences = max((first + (end - begin) // many for _, begin, end, first, many, _ in slots), default=0)
    slots.append((window, 0, int(histogram[window]), sequences, 1, 0))
    placed = spark.createDataFrame(
        slots, "length int, _begin long, _end long, _first long, _many int, _offset int"
    )
    ranked = pieces.join(counts.drop("_count"), ["length", "task"]).withColumn("_rank", F.col("rank") + F.col("_before"))
    past = F.col("_rank") - F.col("_begin")
    return (
        ranked.join(F.broadcast(placed), "length")
        .filter("_begin <= _rank and _rank < _end")
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("_first") + F.floor(past / F.col("_many"))).alias("sequence_id"),
            (F.col("_offset") + past % F.col("_many") * F.col("length")).cast("long").alias("offset"),
        )
    )
