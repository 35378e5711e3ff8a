"""Queries on files, decoders, row building, sinks, webhooks and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrain.catalog import Query
from hitgrain.catalog import sql as S
from hitgrain.catalog.coverage import text
from hitgrain.functions import lines as L
from hitgrain.functions.paths import fix_path
from hitgrain.operators import decoding as D
from hitgrain.operators import rows as R
from hitgrain.operators import sinks
from hitgrain.session import stage_table, work_dir
from hitgrain.sources import bind, diffs, events, files, render, webhooks

DECODED = ["upload_id", "file_seq", "file_name", "ident", "line_number", "type", "hits", "branch_json"]


def decoded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c).cast("int").alias(c) if c == "file_seq" else F.col(c) for c in DECODED],
        text("branch_hits").alias("branch_hits"),
    )


def lcov_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_lcov(render.lcov_records(spark, d), render.upload_fields(spark, d))


def document_files(spark: SparkSession, d: str) -> DataFrame:
    docs = bind.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("upload_id"), F.col("text").alias("content"))


def q_detect_format(spark: SparkSession, d: str) -> DataFrame:
    """LCOV and Go reports of all uploads, Clover elements as text, and documents that are no report."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumn("upload_id", F.concat(F.lit(prefix), "upload_id"))

    clover = render.clover_elements(spark, d).select(
        "upload_id",
        F.col("file_seq").cast("bigint").alias("seq"),
        F.concat(F.lit("<coverage>"), F.col("element")).alias("rec"),
    )
    records = (
        named(render.lcov_records(spark, d), "lcov-")
        .unionByName(named(render.go_records(spark, d), "go-"))
        .unionByName(named(clover, "clover-"))
        .unionByName(D.split_records(document_files(spark, d)))
    )
    orders = bind.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("upload_id"))
    uploads = (
        named(orders, "lcov-")
        .unionByName(named(orders, "go-"))
        .unionByName(named(orders, "clover-"))
        .unionByName(document_files(spark, d).select("upload_id"))
    )
    return D.detect_format(records, uploads)


def q_scan_coverage_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as small text files per source, read back whole with a manifest."""
    root = work_dir(spark, "coverage-files")
    docs = bind.table(spark, d, "documents").select("source", F.col("text").alias("value"))
    docs.write.option("maxRecordsPerFile", 500).partitionBy("source").text(root)
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    manifest = listing.select(
        "path",
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in ("uploadid", "projectId", "projectroot", "commit", "tag", "parent")]),
            F.array(source, F.lit(""), F.lit("/build/"), F.lit("c1"), F.lit("unit"), F.lit('["c0"]')),
        ).alias("metadata"),
    )
    scanned = files.scan_coverage_files(spark, root, manifest)
    records = D.split_records(scanned.select("upload_id", "content"))
    fields = scanned.groupBy("upload_id").agg(
        F.count("project_id").alias("with_project"), F.max("project_root").alias("project_root"), F.max(F.get("parent", F.lit(0))).alias("parent")
    )
    counted = records.groupBy("upload_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("rec")).alias("chars"))
    return counted.join(fields, "upload_id")


def q_scan_records(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as one folder of text files per source and read line by line; every record with its number of occurrences."""
    root = work_dir(spark, "records")
    docs = bind.table(spark, d, "documents").select("source", F.col("text").alias("value"))
    docs.write.partitionBy("source").text(root)
    scanned = files.scan_records(spark, root)
    return scanned.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("upload_id"), "rec").agg(F.count(F.lit(1)).alias("n"))


def q_fix_paths(spark: SparkSession, d: str) -> DataFrame:
    """Line paths under four layouts, chosen by the line's type and number; a broken rule, groups that are and are not there, a lone ``$``."""
    rows = bind.lines(spark, d)
    path = (
        F.when(F.col("type") == L.BRANCH, F.concat(F.lit("/build/"), F.col("file_name")))
        .when(F.col("type") == L.METHOD, F.concat(F.lit("GENERATED/x/y/"), F.col("file_name"), F.lit("/")))
        .when(F.col("line_number") > 20, F.concat(F.lit("github.com/own/rep/"), F.col("file_name")))
        .otherwise(F.col("file_name"))
    )
    rules = F.array(
        F.struct(F.lit("^never/").alias("before"), F.lit("no/").alias("after")),
        F.struct(F.lit("^generated/([").alias("before"), F.lit("broken/").alias("after")),
        F.struct(F.lit("^generated/(.*?)/y/").alias("before"), F.lit(r"gen\1${7}$/").alias("after")),
        F.struct(F.lit("gen").alias("before"), F.lit("twice").alias("after")),
    )
    fixed = fix_path(path, F.lit("own"), F.lit("rep"), F.lit("/build/"), rules)
    return rows.select("upload_id", "line_number", "type", path.alias("path"), fixed.alias("file_name"))


def q_clamp_generated_at(spark: SparkSession, d: str) -> DataFrame:
    now = 1_700_100_000
    seconds = F.lit(1_700_000_000) + F.col("event_id") * 17
    epoch = F.when(F.col("event_type") == "click", seconds * 1000 + 250).otherwise(seconds)
    return bind.table(spark, d, "events").select(
        "event_id", L.clamp_generated_at(epoch, F.lit(now)).alias("generated_at")
    )


def q_validate_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = bind.table(spark, d, "orders")
    digest = F.md5(F.col("o_orderkey").cast("string"))
    rows = orders.select(
        F.col("o_orderkey").alias("upload_no"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.concat(digest, F.substring(digest, 1, 8)),
        ).otherwise(F.substring(digest, 1, 39)).alias("commit"),
        F.concat(
            F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-7"), F.substring(digest, 14, 3),
            F.lit("-a"), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
        ).alias("project"),
        F.col("o_orderpriority").alias("tag"),
        (F.col("o_custkey") - 100).alias("total_lines"),
        (F.col("o_totalprice") / 5000).alias("percentage"),
        F.col("o_orderdate").alias("ingest_time"),
    )
    now = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    rules = {
        "commit": R.matches("commit", R.COMMIT_PATTERN),
        "project": R.matches("project", R.UUID7_PATTERN),
        "tag": R.matches("tag", R.TAG_PATTERN),
        "total_lines": R.not_negative("total_lines"),
        "percentage": R.is_percentage("percentage"),
        "ingest_time": R.not_after("ingest_time", now),
    }
    return R.validate_rows(rows, rules).select("upload_no", F.array_join("reasons", ",").alias("reasons"))


def ingest_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Upload metadata in the layout row building needs."""
    fields = bind.uploads(spark, d).drop("total_lines", "commit_no")
    return fields.select(
        "*",
        F.lit("github").alias("provider"),
        F.lit(render.OWNER).alias("owner"),
        F.lit(render.REPOSITORY).alias("repository"),
        F.array(F.lit("c0000")).alias("parent"),
        F.lit("main").alias("ref"),
        F.lit("LCOV").alias("source_format"),
        F.lit(None).cast("timestamp_ntz").alias("generated_at"),
    )


def q_build_line_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = stage_table(lcov_lines(spark, d), "decoded")
    return R.build_line_rows(lines, ingest_uploads(spark, d)).select(
        "upload_id",
        "commit_id",
        "tag",
        "source_format",
        "file_name",
        "type",
        "line_number",
        "total_lines",
        F.to_json("metadata").alias("metadata"),
    )


def q_build_upload_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = lcov_lines(spark, d)
    headers = D.lcov_files(D.lcov_occurrences(render.lcov_records(spark, d)))
    return R.build_upload_rows(lines, headers, ingest_uploads(spark, d)).select(
        "upload_id", "project_id", "commit_id", "tag", text("parent").alias("parent"), "total_lines"
    )


def q_sink_line_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Write all line rows by ingest day and read the stored metadata back as hits."""
    path = work_dir(spark, "line-coverage")
    up = bind.uploads(spark, d).select("upload_id", "ingest_time")
    lines = bind.lines(spark, d).select("upload_id", "file_name", "line_number", "type", "hits", "branch_json")
    metadata = L.encode_metadata(F.col("type"), F.col("line_number"), F.col("hits"), F.col("branch_json"), F.lit("m"))
    stored = ["upload_id", "file_name", "line_number", "type", metadata.alias("metadata"), "ingest_time", "ingest_date"]
    sinks.sink_line_coverage(lines.join(up, "upload_id"), path, form=lambda rows: rows.select(*stored))
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"), "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(L.extract_line_hits(F.col("metadata"))).alias("hits"),
        F.sum(F.size(L.extract_branch_hits(F.col("metadata")))).alias("branches"),
    )


def q_sink_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Write lines (here in months), then uploads, and check from the uploads that every line is there."""
    root = work_dir(spark, "uploads")
    up = bind.uploads(spark, d, sizes=True)
    month = F.date_trunc("month", F.col("ingest_time").cast("timestamp")).cast("timestamp_ntz").alias("ingest_time")
    rows = bind.lines(spark, d).drop("branch_hits").join(up.select("upload_id", month), "upload_id")
    sinks.write_ingest(rows, up.drop("commit_no"), f"{root}/lines", f"{root}/uploads")
    stored, lines = spark.read.parquet(f"{root}/uploads"), spark.read.parquet(f"{root}/lines")
    counts = lines.groupBy("upload_id").agg(F.count(F.lit(1)).alias("stored_lines"))
    return stored.join(counts, "upload_id", "left").select(
        "upload_id", "project_id", "commit_id", "tag", "total_lines", F.coalesce("stored_lines", F.lit(0)).alias("stored_lines")
    )


def _json(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Known projects: one per nation."""
    return bind.table(spark, d, "nation").select(
        F.lit("github").alias("provider"),
        F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("owner"),
        F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repository"),
        F.concat(F.lit("project-"), F.col("n_nationkey").cast("string")).alias("project_id"),
    )


def _repository(number: Column) -> Column:
    key = number.cast("string")
    return _json(name=F.concat(F.lit("r"), key), owner=_json(login=F.concat(F.lit("o"), key)))


def check_runs(spark: SparkSession, d: str) -> DataFrame:
    """Check-run payloads from events; users beyond the known projects are unknown."""
    ev = bind.table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    done = F.col("event_type").isin("click", "purchase")
    pr = _json(
        number=F.col("event_id"),
        base=_json(ref=F.lit("main"), sha=F.concat(F.lit("b"), F.col("event_id").cast("string"))),
    )
    body = _json(
        repository=_repository(F.col("user_id")),
        check_run=_json(
            id=F.col("event_id"),
            status=F.when(done, F.lit("completed")).otherwise(F.lit("in_progress")),
            started_at=F.lit("2024-01-01T00:00:00"),
            completed_at=F.when(done, stamp),
            app=_json(id=F.col("event_id") % 10),
            check_suite=_json(
                head_branch=F.concat(F.lit("branch-"), F.col("event_type")),
                head_sha=F.concat(F.lit("c"), F.col("user_id").cast("string")),
                before=F.when(F.col("event_type") == "view", F.lit(webhooks.NULL_COMMIT)).otherwise(F.lit("p1")),
            ),
            pull_requests=F.when(F.col("event_type") == "signup", F.array(pr)).otherwise(F.array().cast(
                "array<struct<number:bigint,base:struct<ref:string,sha:string>>>"
            )),
        ),
    )
    return ev.select(F.to_json(body).alias("body"))


def job_states(spark: SparkSession, d: str) -> DataFrame:
    return webhooks.webhook_job_state(check_runs(spark, d), projects(spark, d))


def pushes(spark: SparkSession, d: str) -> DataFrame:
    """Push payloads from events with two commits each; by event type the head is there once, twice or not at all."""
    ev = bind.table(spark, d, "events")
    key = F.col("event_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    touched = F.when(F.col("value") > 20, F.array(F.lit(webhooks.CONFIG_PATH))).otherwise(F.array(F.lit("a.py")))
    head = F.concat(F.lit("h"), key)
    other = F.when(F.col("event_type") == "view", head).otherwise(F.concat(F.lit("x"), key))
    commits = F.array(
        _json(id=other, timestamp=F.lit("2024-01-01T00:00:00"), added=F.array(F.lit("b.py")), modified=touched, removed=F.array(F.lit("c.py"))),
        _json(
            id=F.when(F.col("event_type") == "error", F.lit("gone")).otherwise(head),
            timestamp=stamp,
            added=F.array(F.lit("d.py")),
            modified=F.array(F.lit("e.py")),
            removed=F.array(F.lit("f.py")),
        ),
    )
    ref = (
        F.when(F.col("event_type") == "signup", F.lit("refs/tags/v1"))
        .when(F.col("event_id") % 2 == 0, F.lit("refs/heads/main"))
        .otherwise(F.lit("refs/heads/topic"))
    )
    body = _json(repository=_repository(F.col("user_id")), ref=ref, after=head, commits=commits)
    return ev.select("event_id", F.to_json(body).alias("body"))


def q_webhook_config_change(spark: SparkSession, d: str) -> DataFrame:
    return webhooks.main_branch_changes(
        webhooks.webhook_config_change(pushes(spark, d), projects(spark, d))
    ).select(
        "project_id", "owner", "repository", "ref", "commit_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time")
    )


def q_changed_files_union(spark: SparkSession, d: str) -> DataFrame:
    push = pushes(spark, d).select("event_id", F.from_json("body", webhooks.PUSH)["commits"].alias("commits"))
    return push.select("event_id", text(webhooks.changed_files_union(F.col("commits"))).alias("files"))


def patches(spark: SparkSession, d: str) -> DataFrame:
    """Every file's added lines as one patch, a hunk per line with a removed and a kept line around it."""
    added = bind.diff(spark, d)
    hunk = F.concat(
        F.lit("@@ -1,2 +"),
        (F.col("line_number") - 1).cast("string"),
        F.lit(",2 @@ def f():\n kept\n-removed\n+added "),
        F.col("line_number").cast("string"),
    )
    return added.groupBy("project_id", "commit_id", F.concat(F.lit("b/"), F.col("file_name")).alias("file_name")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_number", hunk.alias("h")))), lambda e: e["h"]), "\n"
        ).alias("patch")
    )


def q_scan_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read by a stream until its input is used up."""
    root = work_dir(spark, "events")
    ev = bind.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "JOB_STATE_CHANGE").when(
        F.col("event_type") == "purchase", "COVERAGE_FINALISED"
    ).when(F.col("event_type") == "view", "INGEST_SUCCESS").otherwise(F.lit("SOMETHING_ELSE"))
    body = _json(
        type=kind,
        provider=F.lit("github"),
        projectId=F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")),
        commit=F.concat(F.lit("c"), F.col("user_id").cast("string")),
        coveragePercentage=F.when(F.col("event_type") == "purchase", F.col("value")),
        eventTime=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    ev.select(F.to_json(body).alias("value")).write.text(f"{root}/in")
    stream = events.of_type(events.scan_events(spark, f"{root}/in"), "JOB_STATE_CHANGE", "COVERAGE_FINALISED")
    query = (
        stream.select("type", "project_id", "commit_id", "coverage_percentage", "event_time")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        "type", "project_id", "commit_id", "coverage_percentage",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
    )


JOB_COLUMNS = ["project_id", "owner", "repository", "ref", "commit_id"]
QUERIES: dict[str, Query] = {
    "scan_coverage_files": q_scan_coverage_files,
    "scan_records": q_scan_records,
    "split_records": lambda s, d: D.split_records(document_files(s, d)),
    "detect_format": q_detect_format,
    "decode_lcov": lambda s, d: decoded(lcov_lines(s, d)),
    "decode_gocover": lambda s, d: decoded(D.decode_gocover(render.go_records(s, d), render.upload_fields(s, d))),
    "gocover_block_check": lambda s, d: D.gocover_block_check(D.go_blocks(render.go_records(s, d))),
    "decode_clover": lambda s, d: decoded(
        D.decode_clover(D.parse_clover_elements(render.clover_elements(s, d)), render.upload_fields(s, d))
    ),
    "clamp_generated_at": q_clamp_generated_at,
    "validate_rows": q_validate_rows,
    "fix_paths": q_fix_paths,
    "build_line_rows": q_build_line_rows,
    "build_upload_rows": q_build_upload_rows,
    "sink_line_coverage": q_sink_line_coverage,
    "sink_uploads": q_sink_uploads,
    "webhook_job_state": lambda s, d: job_states(s, d).select(
        *JOB_COLUMNS,
        text("parent").alias("parent"),
        "external_id",
        "triggered_by",
        "state",
        "pull_request",
        "base_ref",
        "base_commit",
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
    ),
    "project_lookup": lambda s, d: webhooks.project_lookup(
        bind.table(s, d, "customer").select(
            "c_custkey",
            F.lit("github").alias("provider"),
            F.concat(F.lit("o"), (F.col("c_custkey") % 50).cast("string")).alias("owner"),
            F.concat(F.lit("r"), (F.col("c_custkey") % 50).cast("string")).alias("repository"),
        ),
        projects(s, d),
    ).select("c_custkey", "project_id"),
    "webhook_config_change": q_webhook_config_change,
    "changed_files_union": q_changed_files_union,
    "diff_added_lines": lambda s, d: diffs.diff_added_lines(patches(s, d)),
    "scan_events": q_scan_events,
}

S.BLOCKS["report_line"] = """
  select upload_id, file_no, line_number, type, hits, is_object,
    case when is_object or branch_json is null then 1 else cast(json_extract(branch_json, '$[0]') as bigint) end as b0,
    case when is_object or branch_json is null then 2 else cast(json_extract(branch_json, '$[1]') as bigint) end as b1
  from (
    select upload_id, cast(regexp_extract(file_name, '([0-9]+)', 1) as integer) as file_no, line_number,
      max(type) as type, max(hits) as hits, max(branch_json) as branch_json,
      max(type) = 'BRANCH' and max(branch_json) like '{%' as is_object
    from line_cov group by 1, 2, 3)"""
S.BLOCKS["lcov_line"] = """
  select upload_id, cast(dense_rank() over (partition by upload_id order by file_no) as integer) as file_seq,
    concat('src/f', cast(file_no as varchar), '.py') as file_name,
    case when type = 'METHOD' then concat('m', cast(line_number as varchar)) else cast(line_number as varchar) end as ident,
    line_number, type, hits,
    case when type = 'BRANCH' then case when is_object then '{"0":1,"3":2}'
      else concat('[', cast(b0 as varchar), ',', cast(b1 as varchar), ']') end end as branch_json,
    case when type = 'BRANCH' and not is_object then concat(cast(b0 as varchar), ',', cast(b1 as varchar)) else '' end as branch_hits
  from report_line"""
_GO_ROW = """select upload_id, file_no, {line} as line_number, {type} as type, {hits} as hits, {json} as branch_json,
  {list} as branch_hits from report_line where {where}"""
S.BLOCKS["go_line"] = " union all ".join(
    [
        _GO_ROW.format(line="line_number * 3", type="'STATEMENT'", hits="hits", json="null", list="''", where="type = 'STATEMENT'"),
        _GO_ROW.format(line="line_number * 3 + 1", type="'STATEMENT'", hits="hits", json="null", list="''", where="type = 'STATEMENT'"),
        _GO_ROW.format(
            line="line_number * 3",
            type="'BRANCH'",
            hits="b0 + b1",
            json="concat('[', cast(b0 as varchar), ',', cast(b1 as varchar), ']')",
            list="concat(cast(b0 as varchar), ',', cast(b1 as varchar))",
            where="type = 'BRANCH' and not is_object",
        ),
        _GO_ROW.format(
            line="line_number * 3",
            type="'BRANCH'",
            hits="hits + 3",
            json="""concat('{{"0":', cast(hits as varchar), ',"1":1,"3":2}}')""".replace("{{", "{").replace("}}", "}"),
            list="''",
            where="type = 'METHOD'",
        ),
        _GO_ROW.format(line="line_number * 3", type="'BRANCH'", hits="16", json="'[7,9]'", list="'7,9'", where="is_object"),
        _GO_ROW.format(line="line_number * 3 - 1", type="'STATEMENT'", hits="7", json="null", list="''", where="is_object"),
    ]
)
S.BLOCKS["project"] = """
  select concat('o', cast(n_nationkey as varchar)) as owner, concat('r', cast(n_nationkey as varchar)) as repository,
    concat('project-', cast(n_nationkey as varchar)) as project_id, n_nationkey as number from nation"""
_SPACE = "concat(' ', chr(9), chr(10), chr(13), chr(0), chr(11))"
S.BLOCKS["doc_record"] = f"""
  select doc_id, source, cast(i - 1 as bigint) as seq, trim(parts[i], {_SPACE}) as rec
  from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i
        from (select doc_id, source, regexp_split_to_array(text, '\\n|\\r\\n?') as parts from documents))
  where trim(parts[i], {_SPACE}) <> ''"""
_DAY = "strftime({}, '%Y-%m-%d %H:%M:%S')"

ORACLES: dict[str, str] = {
    "scan_coverage_files": S.query(
        """select source as upload_id, count(*) as records, cast(sum(length(rec)) as bigint) as chars,
          cast(0 as bigint) as with_project, '/build/' as project_root, 'c0' as parent from doc_record group by source"""
    ),
    "scan_records": S.query(
        "select source as upload_id, rec, count(*) as n from doc_record group by source, rec"
    ),
    "split_records": S.query("select concat('doc-', cast(doc_id as varchar)) as upload_id, seq, rec from doc_record"),
    "detect_format": S.query(
        """select concat('lcov-', cast(o_orderkey as varchar)) as upload_id,
          case when exists (select 1 from lineitem where l_orderkey = o_orderkey) then 'LCOV' else 'GO_COVER' end as format from orders
        union all select concat('go-', cast(o_orderkey as varchar)), 'GO_COVER' from orders
        union all select concat('clover-', cast(o_orderkey as varchar)),
          case when exists (select 1 from lineitem where l_orderkey = o_orderkey) then 'CLOVER' else 'GO_COVER' end from orders
        union all select concat('doc-', cast(d.doc_id as varchar)),
          case when exists (select 1 from doc_record r where r.doc_id = d.doc_id) then null else 'GO_COVER' end from documents d"""
    ),
    "decode_lcov": S.query("select * from lcov_line"),
    "decode_gocover": S.query(
        """select g.upload_id, file_seq, concat('src/f', cast(g.file_no as varchar), '.go') as file_name,
          cast(line_number as varchar) as ident, cast(line_number as integer) as line_number, type, cast(hits as bigint) as hits,
          branch_json, branch_hits
        from go_line g
        join (select upload_id, file_no, cast(dense_rank() over (partition by upload_id order by file_no) as integer) as file_seq
              from (select distinct upload_id, file_no from report_line)) f
          on f.upload_id = g.upload_id and f.file_no = g.file_no
        where g.upload_id not in (select cast(o_orderkey as varchar) from orders where o_orderstatus = 'P')"""
    ),
    "gocover_block_check": "select cast(o_orderkey as varchar) as upload_id from orders where o_orderstatus = 'P'",
    "decode_clover": S.query(
        """select upload_id, file_no as file_seq, concat('src/f', cast(file_no as varchar), '.py') as file_name,
          case when type = 'METHOD' then concat('m', cast(line_number as varchar)) else cast(line_number as varchar) end as ident,
          line_number, type, hits,
          case when type = 'BRANCH' then concat('[', cast(b0 as varchar), ',', cast(b1 as varchar), ']') end as branch_json,
          case when type = 'BRANCH' then concat(cast(b0 as varchar), ',', cast(b1 as varchar)) else '' end as branch_hits
        from report_line"""
    ),
    "clamp_generated_at": """
        select event_id, least(1700100000.0::double, case when epoch > 1700100000 then epoch / 1000.0::double else epoch::double end) as generated_at
        from (select event_id, case when event_type = 'click' then (1700000000 + event_id * 17) * 1000 + 250
              else 1700000000 + event_id * 17 end as epoch from events)""",
    "validate_rows": """
        select o_orderkey as upload_no, concat_ws(',', case when o_orderstatus = 'P' then 'commit' end,
          case when o_orderpriority like '% %' then 'tag' end, case when o_custkey < 100 then 'total_lines' end,
          case when not (o_totalprice / 5000 between 0 and 100) then 'percentage' end,
          case when o_orderdate > timestamp '2000-01-01' then 'ingest_time' end) as reasons from orders""",
    "fix_paths": S.query(
        """select upload_id, line_number, type,
          case when type = 'BRANCH' then concat('/build/', file_name) when type = 'METHOD' then concat('GENERATED/x/y/', file_name, '/')
            when line_number > 20 then concat('github.com/own/rep/', file_name) else file_name end as path,
          case when type = 'METHOD' then concat('genx$/', file_name) else file_name end as file_name
        from line_cov"""
    ),
    "build_line_rows": S.query(
        """select l.upload_id, u.commit_id, u.tag, 'LCOV' as source_format, l.file_name, l.type, l.line_number,
          count(*) over (partition by l.upload_id) as total_lines,
          concat('[{"key":"type","value":"', l.type, '"},{"key":"lineNumber","value":"', cast(l.line_number as varchar),
            '"},{"key":"lineHits","value":"', cast(l.hits as varchar), '"}',
            case when l.type = 'BRANCH' then concat(',{"key":"branchHits","value":"', replace(l.branch_json, '"', chr(92) || '"'), '"}') else '' end,
            case when l.type = 'METHOD' then concat(',{"key":"name","value":"', l.ident, '"}') else '' end, ']') as metadata
        from lcov_line l join upload u on u.upload_id = l.upload_id"""
    ),
    "build_upload_rows": S.query(
        """select u.upload_id, u.project_id, u.commit_id, u.tag, 'c0000' as parent, t.n as total_lines
        from upload u join (select upload_id, count(*) as n from report_line group by upload_id) t on t.upload_id = u.upload_id"""
    ),
    "sink_line_coverage": S.query(
        """select strftime(u.ingest_time, '%Y-%m-%d') as ingest_date, l.type, count(*) as n, cast(sum(l.hits) as bigint) as hits,
          cast(sum(len(l.branch_hits)) as bigint) as branches
        from line_cov l join upload u on u.upload_id = l.upload_id group by 1, 2"""
    ),
    "sink_uploads": S.query(
        "select upload_id, project_id, commit_id, tag, total_lines, total_lines as stored_lines from upload"
    ),
    "webhook_job_state": S.query(
        f"""select p.project_id, p.owner, p.repository, concat('branch-', event_type) as ref, concat('c', cast(user_id as varchar)) as commit_id,
          case when event_type = 'view' then '' else 'p1' end as parent, event_id as external_id, event_id % 10 as triggered_by,
          case when event_type in ('click', 'purchase') then 'completed' else 'in_progress' end as state,
          case when event_type = 'signup' then event_id end as pull_request,
          case when event_type = 'signup' then 'main' end as base_ref,
          case when event_type = 'signup' then concat('b', cast(event_id as varchar)) end as base_commit,
          case when event_type in ('click', 'purchase') then {_DAY.format('ts')} else '2024-01-01 00:00:00' end as event_time
        from events join project p on p.number = user_id"""
    ),
    "project_lookup": S.query(
        "select c_custkey, p.project_id from customer join project p on p.number = c_custkey % 50"
    ),
    "webhook_config_change": S.query(
        f"""select p.project_id, p.owner, p.repository, 'main' as ref, concat('h', cast(event_id as varchar)) as commit_id,
          {_DAY.format('ts')} as event_time
        from events join project p on p.number = user_id
        where event_type in ('click', 'purchase') and event_id % 2 = 0 and value > 20"""
    ),
    "changed_files_union": """
        select event_id, concat('b.py,', case when value > 20 then 'coverage.yml' else 'a.py' end, ',c.py,d.py,e.py,f.py') as files from events""",
    "diff_added_lines": S.query("select project_id, commit_id, file_name, line_number, diff_index from diff"),
    "scan_events": f"""
        select case event_type when 'click' then 'JOB_STATE_CHANGE' else 'COVERAGE_FINALISED' end as type,
          concat('p', cast(user_id % 5 as varchar)) as project_id, concat('c', cast(user_id as varchar)) as commit_id,
          case when event_type = 'purchase' then value end as coverage_percentage, {_DAY.format('ts')} as event_time
        from events where event_type in ('click', 'purchase')""",
}
