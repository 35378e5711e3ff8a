"""Streams run to the end of their input and agree with the batch operators."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from hitgrain.functions import lines as L
from hitgrain.operators import orchestration as O
from hitgrain.operators.scope import scope_uploads
from hitgrain.operators.sinks import sink_line_coverage
from hitgrain.session import stage_table
from hitgrain.sources import bind
from hitgrain.sources.stored import stored_lines, stored_uploads
from hitgrain.streaming.chain import decide, ingest_events, latest_reports, report_decided, stored_outcomes
from hitgrain.streaming.jobs import coverage_stream, ingest_metrics, ingest_stream
from hitgrain.streaming.orchestrator import micros, orchestrate
from hitgrain.plans.ingest import upload_rules
from hitgrain.plans.reports import coverage_report, report_scope

SMALL = "/root/testdata/sf0.001"
QUIET = timedelta(minutes=30)


def run(stream, path):
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def rows(df):
    return sorted(map(tuple, df.collect()))


def micros_of(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


def test_orchestrator_agrees_with_batch(spark, tmp_path):
    """Events out of order in their own times, by up to ten days, in five micro-batches by arrival."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    back = F.make_dt_interval(days=(F.col("event_id") % 11).cast("int"))
    events = bind.job_events(spark, SMALL).withColumn("event_time", F.col("event_time") - back)
    verdicts = {r.dropped for r in O.screen_events(events).select("dropped").distinct().collect()}
    assert verdicts == {None, "late", "regression"}
    end = events.agg(F.max("event_id").alias("m")).select(
        F.lit("none").alias("repository_id"), F.lit("none").alias("commit_id"), F.lit("none").alias("identifier"),
        F.lit("JOB").alias("kind"), F.lit("IN_PROGRESS").alias("state"),
        F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")).alias("event_time"), (F.col("m") + 1).alias("event_id"),
        F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")).alias("stored_time"),
    )
    source = str(tmp_path / "events")
    for part in range(4):
        events.filter(F.col("event_id").between(part * 250 + (part > 0), (part + 1) * 250)).coalesce(1).write.mode("append").parquet(source)
    assert spark.read.parquet(source).count() == events.count()
    end.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(source)
    run(orchestrate(stream, QUIET, lifetime=timedelta(days=36_500)), str(tmp_path))
    out = spark.read.parquet(str(tmp_path / "out")).filter("commit_id <> 'none'")
    recorded = O.recorded_events(events)
    us, stored = micros_of("event_time"), micros_of("stored_time")
    started = O.uploads_started(events).select(*O.COMMIT, us)
    assert rows(out.filter("output = 'uploads_started'").select(*O.COMMIT, "event_us")) == rows(started)
    entries = F.array_sort(F.map_entries("change")).alias("change")
    changes = O.event_state_changes(recorded).select(*O.IDENTITY, "version", entries, us)
    assert rows(out.filter("output = 'state_change'").select(*O.IDENTITY, "version", entries, "event_us")) == rows(changes)
    finalised = O.uploads_finalised(recorded, QUIET).select(*O.COMMIT, us, stored)
    streamed = rows(out.filter("output = 'uploads_finalised'").select(*O.COMMIT, "event_us", "stored_us"))
    assert streamed and streamed == rows(finalised)


CI_EVENTS = (
    "repository_id string, commit_id string, identifier string, kind string, state string, event_time timestamp_ntz, "
    "event_id bigint, stored_time timestamp_ntz, ref string, head string"
)


def ci_event(number, commit, job, state, second, ref="main", head=None, start=datetime(2024, 1, 1)):
    at = start + timedelta(seconds=second)
    return ("r", commit, f"{commit}-{job}", "JOB", state, at, number, at, ref, head)


def folded_model(events, fields):
    """Changes of each identifier: what is new by value against the state folded so far."""
    states, out = {}, []
    for e in events:
        new = {name: value for name, value in fields(e).items() if value is not None}
        state, version = states.get(e[2], ({}, 0))
        change = {k: v for k, v in new.items() if v not in state.values()}
        if change:
            version += 1
            out.append((e[2], version, sorted(change.items())))
        states[e[2]] = ({**state, **change}, version)
    return sorted(out)


def test_versions_of_any_fields_compare_values(spark, tmp_path):
    """A value that another field of the stored state has already is no change; the field keeps its old value."""
    rng = random.Random(8)
    events = [ci_event(0, "c", 0, "IN_PROGRESS", 0, "a", "b"), ci_event(1, "c", 0, "IN_PROGRESS", 0, "b", "b"), ci_event(2, "c", 0, "IN_PROGRESS", 0, "a", "a")]
    for i in range(3, 300):
        events.append(ci_event(i, f"c{rng.randint(0, 2)}", rng.randint(0, 1), "IN_PROGRESS", i, rng.choice("abc"), rng.choice(["a", "b", None])))
    expected = folded_model(events, lambda e: {"ref": e[8], "head": e[9], "state": e[4]})
    assert [e for e in expected if e[0] == "c-0"] == [("c-0", 1, [("head", "b"), ("ref", "a"), ("state", "IN_PROGRESS")])]
    spark.createDataFrame(events, CI_EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CI_EVENTS).parquet(str(tmp_path / "in"))
    run(orchestrate(stream, fields={name: F.col(name) for name in ("ref", "head", "state")}), str(tmp_path))
    out = spark.read.parquet(str(tmp_path / "out")).filter("output = 'state_change'")
    assert sorted((r.identifier, r.version, sorted(r.change.items())) for r in out.collect()) == expected


def test_job_beyond_its_life_blocks_no_more(spark, tmp_path):
    life, quiet = timedelta(seconds=100), timedelta(seconds=5)
    events = [
        ci_event(0, "c", 0, "IN_PROGRESS", 0), ci_event(1, "c", 1, "SUCCESS", 50), ci_event(2, "c", 2, "SUCCESS", 99),
        ci_event(3, "c", 3, "SUCCESS", 101), ci_event(4, "d", 0, "IN_PROGRESS", 0), ci_event(5, "d", 0, "IN_PROGRESS", 90),
        ci_event(6, "d", 1, "SUCCESS", 120), ci_event(7, "end", 0, "IN_PROGRESS", 9000),
    ]
    spark.createDataFrame(events, CI_EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CI_EVENTS).parquet(str(tmp_path / "in"))
    run(orchestrate(stream, quiet, lifetime=life), str(tmp_path))
    out = spark.read.parquet(str(tmp_path / "out")).filter("output = 'uploads_finalised'")
    start = micros(datetime(2024, 1, 1) - datetime(1970, 1, 1))
    assert [(r.commit_id, (r.stored_us - start) // 1_000_000) for r in out.collect()] == [("c", 101)]
    kept = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "commit").load()
    assert [r.key.commit_id for r in kept.collect()] == ["end"]


def test_wall_clock_finalises_and_state_expires(spark, tmp_path):
    """With nothing further coming in, the quiet period ends by itself, and the state store drops the state after its life."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    events = [ci_event(0, "c", 0, "SUCCESS", 0, start=now), ci_event(1, "d", 0, "IN_PROGRESS", 0, start=now)]
    spark.createDataFrame(events, CI_EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CI_EVENTS).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    started = orchestrate(stream, timedelta(seconds=1), lifetime=timedelta(seconds=20), wall_clock=True)
    query = started.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()

    def state(name):
        reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        return reader.load().count()

    def until(reached):
        end = time.monotonic() + 90
        while not reached():
            assert time.monotonic() < end and query.isActive
            time.sleep(0.5)

    try:
        until(lambda: any("_spark_metadata" == f.name for f in (tmp_path / "out").glob("*")))
        until(lambda: spark.read.schema(started.schema).parquet(out).filter("output = 'uploads_finalised'").count() == 1)
        assert state("commit") == 2 and state("jobs") == 2
        until(lambda: state("commit") == 0 and state("jobs") == 0)
    finally:
        query.stop()
    final = spark.read.parquet(out).filter("output = 'uploads_finalised'")
    assert [(r.commit_id, r.event_us) for r in final.collect()] == [("c", micros(now - datetime(1970, 1, 1)))]


def test_coverage_stream(spark, tmp_path):
    def tables():
        return {
            "uploads": bind.uploads(spark, SMALL, sizes=True),
            "lines": bind.lines(spark, SMALL),
            "history": bind.history(spark, SMALL, bind.DENSE),
            "tag_settings": bind.tag_settings(spark, SMALL),
        }

    waypoints = bind.waypoints(spark, SMALL)
    source = str(tmp_path / "finalised")
    waypoints.select("project_id", "commit_id").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("project_id string, commit_id string").option("maxFilesPerTrigger", "2").parquet(source)
    query = coverage_stream(stream, tables, str(tmp_path / "reports"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    t = tables()
    expected = coverage_report(waypoints, report_scope(waypoints, t["uploads"], t["history"], t["tag_settings"]), t["lines"])
    got = spark.read.parquet(str(tmp_path / "reports")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


FILES = {
    "lcov.info": "TN:\nSF:/build/src/a.py\nFN:1,f\nFNDA:2,f\nDA:1,2\nDA:2,0\nBRDA:2,0,0,1\nBRDA:2,0,1,-\nend_of_record\n",
    "cover.out": "mode: set\ngithub.com/own/rep/b.go:1.1,2.9 1 3\ngithub.com/own/rep/b.go:2.9,2.20 1 0\n",
    "clover.xml": '<?xml version="1.0"?>\n<coverage generated="1"><project timestamp="1681657109"><package name="p"><file name="c.php">'
    '<line num="3" type="stmt" count="1"/><line num="4" type="cond" count="1" truecount="2" falsecount="0"/></file></package></project></coverage>',
    "broken.xml": "<?xml version=\"1.0\"?>\n<coverage><project><file name=\"d\"><line num=\"1\"</coverage>",
    "backwards.out": "mode: set\nx.go:9.1,3.1 1 1\n",
    "notes.txt": "this is no coverage report\n",
    "empty.out": "mode: set\n",
}


HISTORY = "project_id string, commit_id string, number int, merged boolean, ref string, parents array<string>"


def scans_of(plan, found):
    """File scans below a physical plan, through adaptive stages and subqueries of the exchange."""
    name = plan.getClass().getSimpleName()
    if name == "FileSourceScanExec":
        found.append(plan)
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    if not inner:
        children = plan.children()
        inner = [children.apply(i) for i in range(children.size())]
    for child in inner:
        scans_of(child, found)
    return found


def test_reports_read_only_days_in_scope(spark, tmp_path):
    """Of a line table with many days a report reads the folders of the days on which its uploads came in."""
    days = [f"2024-01-{day:02}" for day in range(1, 21)]
    uploads = spark.createDataFrame(
        [(f"u{i}", "p", f"c{i}", "unit", day, 3) for i, day in enumerate(days)], "upload_id string, project_id string, commit_id string, tag string, day string, total_lines long"
    ).withColumn("ingest_time", F.to_timestamp_ntz("day"))
    rows = uploads.select("upload_id", "ingest_time", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line_number"))
    metadata = L.encode_metadata(F.lit("STATEMENT"), F.col("line_number"), F.col("line_number") - 1, F.lit(None), F.lit("m"))
    rows = rows.select("*", F.lit("a.py").alias("file_name"), F.lit("STATEMENT").alias("type"), metadata.alias("metadata"))
    sink_line_coverage(rows, str(tmp_path / "lines"))
    waypoints = uploads.filter(F.col("commit_id").isin("c3", "c7")).select("project_id", "commit_id")
    scope = stage_table(scope_uploads(uploads, waypoints), "scope")
    report = coverage_report(waypoints, scope, stored_lines(spark, str(tmp_path / "lines")))
    assert sorted((r.commit_id, r.lines, r.at_least_partial, r.uncovered) for r in report.collect()) == [("c3", 3, 2, 1), ("c7", 3, 2, 1)]
    plan = report._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    lines = [s for s in scans_of(plan, []) if "ingest_date" in s.relation().partitionSchema().simpleString()]
    assert [s.metrics().apply("numPartitions").value() for s in lines] == [2]
    assert [s.metrics().apply("numOutputRows").value() for s in lines] == [6]
    assert "metadata" in lines[0].requiredSchema().simpleString() and "ingest_time" not in lines[0].requiredSchema().simpleString()


def test_ingest_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, content in FILES.items():
        (source / name).write_text(content)
    rows = [
        (
            f"file://{source}/{name}",
            {"uploadid": name, "projectId": "p", "provider": "github", "owner": "own", "repository": "rep",
             "ref": "main", "tag": "unit", "commit": "c1", "parent": '["c0"]', "projectroot": "/build/"},
        )
        for name in FILES
    ]

    def manifest():
        return spark.createDataFrame(rows, "path string, metadata map<string,string>").select(
            "path", "metadata", F.to_timestamp_ntz(F.lit("2024-05-01 10:00:00")).alias("event_time"),
            F.array().cast("array<struct<before:string,after:string>>").alias("path_replacements"),
        )

    query = ingest_stream(spark, str(source), manifest, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out/outcomes")).collect()
    reasons = {r.upload_id: r.reasons for r in told if r.reasons}
    assert reasons == {"broken.xml": ["malformed"], "backwards.out": ["malformed"], "notes.txt": ["unknown_format"]}
    outcomes = {r.upload_id: (r.format, r.state) for r in told}
    assert outcomes == {
        "lcov.info": ("LCOV", "INGEST_SUCCESS"),
        "cover.out": ("GO_COVER", "INGEST_SUCCESS"),
        "clover.xml": ("CLOVER", "INGEST_SUCCESS"),
        "broken.xml": ("CLOVER", "INGEST_FAILURE"),
        "backwards.out": ("GO_COVER", "INGEST_FAILURE"),
        "notes.txt": (None, "INGEST_FAILURE"),
        "empty.out": ("GO_COVER", "INGEST_SUCCESS"),
    }
    uploads = {r.upload_id: (r.total_lines, r.generated_at) for r in spark.read.parquet(str(tmp_path / "out/uploads")).collect()}
    assert {k: v[0] for k, v in uploads.items()} == {"lcov.info": 3, "cover.out": 2, "clover.xml": 2}
    assert str(uploads["clover.xml"][1]) == "2023-04-16 14:58:29"
    # From what was stored to a report.
    stored = stored_uploads(spark, str(tmp_path / "out/uploads"))
    waypoints = stored.select("project_id", "commit_id").distinct()
    history = spark.createDataFrame([("p", "c1", 1, True, "main", ["c0"])], HISTORY)
    rules = spark.createDataFrame([], "repository_id string, tag string, carryforward boolean")
    scope = report_scope(waypoints, stored, history, rules)
    (report,) = coverage_report(waypoints, scope, stored_lines(spark, str(tmp_path / "out/lines"))).collect()
    assert (report.uploads, report.size, report.lines, report.at_least_partial, report.uncovered) == (3, 7, 6, 6, 0)
    # The same by the chain of streams, once a later outcome of another commit has passed the quiet period.
    spark.read.parquet(str(tmp_path / "out/outcomes")).filter("upload_id = 'lcov.info'").select(
        "upload_id", "project_id", F.lit("none").alias("commit_id"), "format", "reasons", (F.col("ingest_time") + F.expr("interval 1 day")).alias("ingest_time")
    ).write.parquet(str(tmp_path / "out/outcomes/batch=900/state=OTHER"))
    root = str(tmp_path / "chain")
    decide(ingest_events(stored_outcomes(spark, str(tmp_path / "out/outcomes"))), root, QUIET).awaitTermination()
    decided = spark.read.parquet(f"{root}/decisions").filter("output = 'uploads_finalised'")
    assert [(r.repository_id, r.commit_id) for r in decided.collect()] == [("p", "c1")]
    tables = {"uploads": stored, "lines": stored_lines(spark, str(tmp_path / "out/lines")), "history": history, "tag_settings": rules}
    report_decided(spark, root, lambda: tables).awaitTermination()
    assert latest_reports(spark, root).select(report.__fields__).collect() == [report]
    lines = spark.read.parquet(str(tmp_path / "out/lines"))
    got = sorted(
        (r.upload_id, r.file_name, r.type, r.line_number, dict((m.key, m.value) for m in r.metadata)["lineHits"])
        for r in lines.collect()
    )
    assert got == [
        ("clover.xml", "c.php", "BRANCH", 4, "1"),
        ("clover.xml", "c.php", "STATEMENT", 3, "1"),
        ("cover.out", "b.go", "BRANCH", 2, "3"),
        ("cover.out", "b.go", "STATEMENT", 1, "3"),
        ("lcov.info", "src/a.py", "BRANCH", 2, "0"),
        ("lcov.info", "src/a.py", "METHOD", 1, "2"),
        ("lcov.info", "src/a.py", "STATEMENT", 1, "2"),
    ]


def test_ingest_stream_keeps_bad_uploads_out(spark, tmp_path):
    """Small splits, several micro-batches, uploads that break rules; counts come from the one write of outcomes."""
    source = tmp_path / "in"
    source.mkdir()
    body = "\n".join(["SF:src/a.py", *[f"DA:{n},{n % 3}" for n in range(1, 400)], "end_of_record"])
    commit, rows = "a" * 40, []
    for i in range(6):
        (source / f"r{i}.info").write_text(body if i != 4 else "nothing known\n")
        identifier = f"0190a1b2-c3d4-7{i:03x}-8abc-0123456789ab"
        fields = {"uploadid": identifier, "projectId": identifier, "provider": "github", "owner": "own", "repository": "rep", "ref": "main",
                  "tag": "unit tests" if i in (1, 2) else "unit", "commit": "c1" if i == 2 else commit, "parent": "[]"}
        rows.append((f"file://{source}/r{i}.info", fields))

    def manifest():
        return spark.createDataFrame(rows, "path string, metadata map<string,string>").select(
            "path", "metadata", F.to_timestamp_ntz(F.lit("2024-05-01 10:00:00")).alias("event_time"),
            F.array().cast("array<struct<before:string,after:string>>").alias("path_replacements"),
        )

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        out = str(tmp_path / "out")
        ingest_stream(spark, str(source), manifest, out, str(tmp_path / "checkpoint"), 4, upload_rules()).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    failures = spark.read.parquet(f"{out}/outcomes").filter("state = 'INGEST_FAILURE'")
    assert sorted((r.upload_id[15:18], r.reasons) for r in failures.collect()) == [
        ("001", ["tag"]), ("002", ["commit_id", "tag"]), ("004", ["unknown_format"])
    ]
    lines = spark.read.parquet(f"{out}/lines").groupBy("upload_id").agg(F.count_distinct("line_number").alias("n"), F.max("total_lines").alias("t"))
    assert sorted((r.upload_id[15:18], r.n, r.t) for r in lines.collect()) == [(i, 399, 399) for i in ("000", "003", "005")]
    counts = ingest_metrics(spark, out).filter("batch is null").collect()
    assert {r.metric: r.value for r in counts} == {
        "uploads": 6, "upload_id": 0, "project_id": 0, "commit_id": 1, "tag": 2, "unknown_format": 1, "malformed": 0
    }
    assert ingest_metrics(spark, out).select("batch").distinct().count() == 3
