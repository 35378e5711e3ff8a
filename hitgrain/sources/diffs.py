"""Unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hunk heads and the header lines that carry no content.
HUNK_HEAD = r"^@@\s+-\d+(?:,\s*\d+)?\s+\+(\d+)(?:,\s*\d+)?\s+@@"
HEADER_LINE = r"^(?:diff --git |index [\da-f.]+|[+-]{3} [ab])"
LINE_BREAK = "\r\n|\r|\n"


def trim_side(path: Column) -> Column:
    """Remove the a/ or b/ in front of a diff path."""
    return F.regexp_replace(path, "^[ab]/", "")


def diff_added_lines(patches: DataFrame) -> DataFrame:
    """Added new-side line numbers of (project_id, commit_id, file_name, patch), one patch per file.

    Removed lines do not move the new side, so without them the position of a
    line in its hunk is its distance from the hunk's first line. The patch is
    taken apart inside its row; nothing is shuffled.
    """
    hunks = F.split("patch", r"(?m)^(?=@@\s+-\d)", -1)

    def added(hunk_start: Column, rows: Column) -> Column:
        new_side = F.filter(rows, lambda row: ~F.startswith(row, F.lit("-")) & ~row.rlike(HEADER_LINE))
        numbered = F.transform(
            new_side, lambda row, i: F.when(F.startswith(row, F.lit("+")), (hunk_start + i).cast("int"))
        )
        return F.array_compact(numbered)

    def hunk_lines(hunk: Column) -> Column:
        rows = F.split(F.regexp_replace(hunk, r"(\r\n|\r|\n)\z", ""), LINE_BREAK, -1)
        first = F.regexp_extract(hunk, HUNK_HEAD, 1)
        return F.when(first != "", added(first.try_cast("int"), F.slice(rows, F.lit(2), F.size(rows)))).otherwise(
            F.array().cast("array<int>")
        )

    numbers = F.flatten(F.transform(hunks, hunk_lines))
    return patches.filter(F.col("patch").isNotNull()).select(
        "project_id",
        "commit_id",
        trim_side(F.col("file_name")).alias("file_name"),
        F.posexplode(numbers).alias("diff_index", "line_number"),
    )
