"""Time the headline queries and print one JSON line.

The decoders are timed on records rendered beforehand, as they would find them in files.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores, BENCH_RUNS
how often each query is timed after one warm-up (the best run counts).
"""

from __future__ import annotations

import json
import os
import time

from hitgrain.catalog import all_queries
from hitgrain.operators import decoding
from hitgrain.session import build_session, stage_table
from hitgrain.sources import render

HEADLINE = (
    "line_coverage",
    "total_coverage",
    "file_coverage",
    "tag_coverage",
    "least_covered_files",
    "carryforward_tags",
    "base_commit",
    "coverage_report",
    "file_report",
    "tag_report",
    "pull_request_summary",
    "diff_coverage",
    "missing_coverage_blocks",
    "diff_added_lines",
    "decode_lcov",
    "decode_gocover",
    "decode_clover",
    "split_records",
    "event_state_changes",
    "uploads_finalised",
    "latest_message_per_group",
    "metric_rollup",
)


# Decoders: how to render their input, and what to time on it.
DECODERS = {
    "decode_lcov": (render.lcov_records, decoding.decode_lcov),
    "decode_gocover": (render.go_records, decoding.decode_gocover),
    "decode_clover": (
        render.clover_elements,
        lambda elements, uploads: decoding.decode_clover(decoding.parse_clover_elements(elements), uploads),
    ),
}


def query_of(name: str, spark, directory: str):
    """What to run for a name: the named query, or a decoder on staged input."""
    if name not in DECODERS:
        return lambda: all_queries()[name](spark, directory)
    rendered, decode = DECODERS[name]
    records = stage_table(rendered(spark, directory), name)
    return lambda: decode(records, render.upload_fields(spark, directory))


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "hitgrain-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        query = query_of(name, spark, directory)
        best = float("inf")
        for run in range(runs + 1):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            if run:
                best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
