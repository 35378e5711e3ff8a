"""What several of these operators share: text columns and rows that carry a whole input row."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Words: runs of anything but space and \x09 to \x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
# The input row as one struct, so that no name in it can clash with a result column.
ROW = "row"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def wrapped(df: DataFrame) -> DataFrame:
    """The rows as the single column ``row``."""
    return df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias(ROW))


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stretches(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``most`` bytes together; a longer text stands alone."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def give_back() -> None:
    """Hand memory that this process has freed back to the system, for workers that idle between tasks beside other programs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
