"""Stored lines: the wide form is made after shuffle and sort, and read by compiled expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from hitgrain.functions import lines as L
from hitgrain.operators.sinks import sink_line_coverage


def test_metadata_needs_no_lambda(spark):
    rows = spark.createDataFrame(
        [(1, "BRANCH", 3, 2, "[1,0]"), (2, "BRANCH", 3, None, None), (3, "METHOD", 4, 1, None), (4, "STATEMENT", 5, 0, "[9]"), (5, None, None, 7, None)],
        "k int, type string, line_number int, hits bigint, branch_json string",
    )
    metadata = L.encode_metadata(F.col("type"), F.col("line_number"), F.col("hits"), F.col("branch_json"), F.lit("m"))
    found = rows.select("k", metadata.alias("metadata"))
    back = found.select("k", L.extract_line_hits(F.col("metadata")).alias("hits"), L.extract_branch_hits(F.col("metadata")).alias("b"))
    assert "lambda" not in back._jdf.queryExecution().analyzed().toString()
    keys = {r["k"]: [(e["key"], e["value"]) for e in r["metadata"]] for r in found.collect()}
    assert keys[1] == [("type", "BRANCH"), ("lineNumber", "3"), ("lineHits", "2"), ("branchHits", "[1,0]")]
    assert keys[2] == [("type", "BRANCH"), ("lineNumber", "3"), ("lineHits", ""), ("branchHits", "")]
    assert keys[3] == [("type", "METHOD"), ("lineNumber", "4"), ("lineHits", "1"), ("name", "m")]
    assert keys[4] == [("type", "STATEMENT"), ("lineNumber", "5"), ("lineHits", "0")]
    assert keys[5] == [("type", ""), ("lineNumber", ""), ("lineHits", "7")]
    assert {r["k"]: (r["hits"], r["b"]) for r in back.collect()} == {1: (2, [1, 0]), 2: (0, []), 3: (1, []), 4: (0, []), 5: (7, [])}


def test_first_entry_of_a_key_counts_and_null_entries_are_passed_over(spark):
    form = "k int, metadata array<struct<key:string,value:string>>"
    rows = spark.createDataFrame(
        [(1, [("x", "1"), ("lineHits", "2"), ("lineHits", "3")]), (2, [None, (None, "4"), ("lineHits", "5")]), (3, []), (4, None), (5, [("lineHits", None)])], form
    )
    found = {r[0]: r[1] for r in rows.select("k", L.metadata_value(F.col("metadata"), "lineHits")).collect()}
    assert found == {1: "2", 2: "5", 3: None, 4: None, 5: None}


def test_wide_values_are_made_after_shuffle_and_sort(spark, tmp_path):
    day = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(str(n % 7), "f", n, day + datetime.timedelta(days=n % 3)) for n in range(50)], "upload_id string, file_name string, hits int, ingest_time timestamp")
    plans = []

    def form(ordered):
        assert "wide" not in ordered.columns
        wide = ordered.select("upload_id", "file_name", F.concat(F.lit("wide-"), F.col("hits").cast("string")).alias("wide"), "ingest_date")
        plans.append(wide._jdf.queryExecution().optimizedPlan().toString())
        return wide

    sink_line_coverage(rows, str(tmp_path / "lines"), form=form)
    first = plans[0].splitlines()
    at = [next(i for i, line in enumerate(first) if word in line) for word in ("wide-", "Sort", "RebalancePartitions")]
    assert at == sorted(at)
    back = spark.read.parquet(str(tmp_path / "lines"))
    assert back.columns == ["upload_id", "file_name", "wide", "ingest_date"]
    assert sorted(r["wide"] for r in back.collect()) == sorted(f"wide-{n}" for n in range(50))
