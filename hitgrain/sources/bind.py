"""The driver tables seen as coverage data.

Every binding is a plain projection or join of the given parquet tables, so it
grows with them. ``modulus`` sets how many commits a project has: 1000 leaves
gaps in the tags of a commit (for carry-forward), 20 gives well filled commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitgrain.functions import lines as L

SPARSE, DENSE = 1000, 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def commit_name(number: Column) -> Column:
    return F.concat(F.lit("c"), F.lpad(number.cast("string"), 4, "0"))


def uploads(spark: SparkSession, directory: str, modulus: int = DENSE, sizes: bool = False) -> DataFrame:
    """Uploads from orders; ``sizes`` adds ``total_lines`` (a count over lineitem)."""
    orders = table(spark, directory, "orders")
    number = (F.col("o_orderkey") % modulus).cast("int")
    base = orders.select(
        _text("o_orderkey").alias("upload_id"),
        F.concat(F.lit("p"), _text(F.col("o_custkey") % 5)).alias("project_id"),
        commit_name(number).alias("commit_id"),
        number.alias("commit_no"),
        F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("tag"),
        F.col("o_orderdate").alias("ingest_time"),
        "o_orderkey",
    )
    if not sizes:
        return base.withColumn("total_lines", F.lit(None).cast("bigint")).drop("o_orderkey")
    counts = table(spark, directory, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return base.join(counts, "o_orderkey", "left").withColumn("total_lines", F.coalesce("n", F.lit(0))).drop(
        "n", "o_orderkey"
    )


def lines(spark: SparkSession, directory: str) -> DataFrame:
    """Line coverage from lineitem with typed hits; branch hits are empty where the stored form is an object."""
    items = table(spark, directory, "lineitem")
    branch = F.col("l_returnflag") == "A"

    def hits(column: str, offset: int) -> Column:
        return F.greatest(F.round(F.col(column) * 100).cast("bigint") - offset, F.lit(0).cast("bigint"))

    first, second = hits("l_discount", 3), hits("l_tax", 2)
    listed = branch & (F.col("l_linenumber") != 7)
    return items.select(
        _text("l_orderkey").alias("upload_id"),
        F.concat(F.lit("src/f"), _text(F.col("l_partkey") % 20), F.lit(".py")).alias("file_name"),
        (1 + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 40).cast("int").alias("line_number"),
        F.when(branch, L.BRANCH)
        .when(F.col("l_returnflag") == "N", L.STATEMENT)
        .otherwise(L.METHOD)
        .alias("type"),
        F.greatest(F.col("l_quantity").cast("int") - 25, F.lit(0)).cast("bigint").alias("hits"),
        F.when(listed, F.array(first, second)).otherwise(F.array().cast("array<bigint>")).alias("branch_hits"),
        F.when(listed, F.concat(F.lit("["), _text(first), F.lit(","), _text(second), F.lit("]")))
        .when(branch, F.lit('{"0":1,"3":2}'))
        .alias("branch_json"),
        (F.col("l_linestatus") == "F").alias("in_diff"),
    )


def waypoints(spark: SparkSession, directory: str, modulus: int = DENSE) -> DataFrame:
    return uploads(spark, directory, modulus).select("project_id", "commit_id", "commit_no").distinct()


def ancestor_ref(number: Column) -> Column:
    return F.when(number % 10 >= 7, F.concat(F.lit("feature-"), _text(number % 3)))


def history(spark: SparkSession, directory: str, modulus: int = SPARSE) -> DataFrame:
    """The commit graph of every project; ``number`` is a commit's place in time.

    Commits 7 to 9 of each ten form a feature branch that leaves the main line after its newest commit; the branches of
    even tens are merged into the next commit of the main line.
    """
    number = F.col("commit_no")
    feature = number % 10 >= 7
    earlier = Window.partitionBy("project_id").orderBy("commit_no").rowsBetween(Window.unboundedPreceding, -1)
    main_before = F.max(F.when(~feature, number)).over(earlier)
    feature_before = F.max(F.when(feature, number)).over(earlier)
    branch = F.call_function("div", number, F.lit(10))
    same_branch = feature & (F.call_function("div", feature_before, F.lit(10)) == branch)
    merge = ~feature & (feature_before > F.coalesce(main_before, F.lit(-1))) & (
        F.call_function("div", feature_before, F.lit(10)) % 2 == 0
    )
    parents = F.array_compact(
        F.array(
            F.when(same_branch, commit_name(feature_before)).otherwise(commit_name(main_before)),
            F.when(merge, commit_name(feature_before)),
        )
    )
    return waypoints(spark, directory, modulus).select(
        "project_id",
        "commit_id",
        number.alias("number"),
        parents.alias("parents"),
        F.when(number % 4 != 0, number % 2 == 0).alias("merged"),
        ancestor_ref(number).alias("ref"),
    )


def diff(spark: SparkSession, directory: str, modulus: int = DENSE) -> DataFrame:
    """Added lines per waypoint, with their index in the file's list of added lines."""
    scoped = (
        uploads(spark, directory, modulus)
        .select("upload_id", "project_id", "commit_id")
        .join(lines(spark, directory).filter("in_diff").select("upload_id", "file_name", "line_number"), "upload_id")
    )
    keys = ["project_id", "commit_id", "file_name", "line_number"]
    added = scoped.filter("line_number is not null").select(*keys).distinct()
    in_file = Window.partitionBy(*keys[:3]).orderBy("line_number")
    return added.select(*keys[:3], (F.row_number().over(in_file) - 1).alias("diff_index"), "line_number")


def finalised_events(spark: SparkSession, directory: str, modulus: int = SPARSE) -> DataFrame:
    """One finalised event per waypoint; which base fields it has goes by the commit number."""
    number = F.col("commit_no")
    return waypoints(spark, directory, modulus).select(
        "project_id",
        "commit_id",
        F.concat(F.lit("feature-"), _text(number % 3)).alias("ref"),
        F.when(number % 4 != 0, F.lit("main")).alias("base_ref"),
        F.when(number % 3 != 0, commit_name(F.greatest(number - 5, F.lit(0)))).alias("base_commit"),
        F.when(number % 5 != 0, number.cast("bigint")).alias("pull_request"),
        F.when((number > 0) & (number % 7 != 0), F.array(commit_name(number - 1)))
        .otherwise(F.array().cast("array<string>"))
        .alias("parent"),
    )


def tag_settings(spark: SparkSession, directory: str) -> DataFrame:
    """Tag behaviour per project: p3 carries nothing forward but one tag, p1 carries all but one."""
    projects = (
        table(spark, directory, "orders")
        .select(F.concat(F.lit("p"), _text(F.col("o_custkey") % 5)).alias("repository_id"))
        .distinct()
    )
    default = projects.select(
        "repository_id",
        F.lit(None).cast("string").alias("tag"),
        (F.col("repository_id") != "p3").alias("carryforward"),
    )
    own = projects.filter(F.col("repository_id").isin("p1", "p3")).select(
        "repository_id",
        F.when(F.col("repository_id") == "p1", F.lit("5-LOW")).otherwise(F.lit("1-URGENT")).alias("tag"),
        (F.col("repository_id") == "p3").alias("carryforward"),
    )
    return default.unionByName(own)


def comment_settings(spark: SparkSession, directory: str) -> DataFrame:
    """Comment type per project: p2 hides comments."""
    projects = (
        table(spark, directory, "orders")
        .select(F.concat(F.lit("p"), _text(F.col("o_custkey") % 5)).alias("repository_id"))
        .distinct()
    )
    return projects.select(
        "repository_id",
        F.when(F.col("repository_id") == "p2", F.lit("hidden")).otherwise(F.lit("review_comment")).alias(
            "line_comment_type"
        ),
    )


def job_events(spark: SparkSession, directory: str) -> DataFrame:
    """CI events from the event table; ``event_id`` is the order of arrival."""
    events = table(spark, directory, "events")
    kind = F.when(F.col("event_id") % 4 == 0, F.lit("INGESTION")).otherwise(F.lit("JOB"))
    state = (
        F.when(F.col("event_type") == "error", F.lit("FAILURE"))
        .when(F.col("event_type").isin("view", "signup"), F.lit("IN_PROGRESS"))
        .otherwise(F.lit("SUCCESS"))
    )
    # Times run against the order of arrival for every seventh event, by up to an hour.
    shift = F.when(F.col("event_id") % 7 == 3, F.col("event_id") % 3600).otherwise(F.lit(0)).cast("int")
    return events.select(
        F.concat(F.lit("p"), _text(F.col("user_id") % 5)).alias("repository_id"),
        F.concat(F.lit("c"), _text("user_id")).alias("commit_id"),
        F.concat(F.lit("Job#"), _text("user_id"), F.lit("-"), _text(F.col("event_id") % 4)).alias("identifier"),
        kind.alias("kind"),
        state.alias("state"),
        (F.col("ts") - F.make_dt_interval(secs=shift)).alias("event_time"),
        "event_id",
        F.col("ts").alias("stored_time"),
    )
