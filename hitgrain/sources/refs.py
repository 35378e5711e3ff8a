"""The newest coverage of every ref, kept as a table in buckets and versions.

A write makes new files for the buckets it touches only, below ``data/version=N/bucket=B``. Then it adds ``manifest/version=N``,
which names the version of every bucket: readers see the whole write or nothing of it. A write that stopped halfway left files
that no manifest names; the next write takes the same number and replaces them. Writers come one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from hitgrain.plans.reports import record_ref_coverage
from hitgrain.session import stage_table

KEY = ("repository_id", "ref")
BUCKETS = 256
MANIFEST = "bucket int, data_version bigint, version bigint"
ROWS = "repository_id string, ref string, coverage_percentage double, event_time {time}, version bigint, bucket int"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def ref_version(spark: SparkSession, path: str) -> int:
    """Number of the last whole write; 0 for no table."""
    return _manifests(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def stored_refs(spark: SparkSession, path: str, version: int | None = None, time: str = "bigint") -> DataFrame:
    """Rows of the table as of ``version`` (the last one by default), with their bucket. Other versions' files are not read."""
    version = ref_version(spark, path) if version is None else version
    if version == 0:
        return spark.createDataFrame([], ROWS.format(time=time)).drop("version")
    # At most one row per bucket.
    named = _manifests(spark, path).filter(F.col("version") == version).select("bucket", F.col("data_version").alias("version"))
    data = spark.read.schema(ROWS.format(time=time)).parquet(f"{path}/data")
    return data.join(F.broadcast(named.filter("version > 0")), ["bucket", "version"]).drop("version")


def upsert_refs(path: str, finalised: DataFrame, buckets: int = BUCKETS) -> int:
    """Take new results (repository, ref, percentage, time) into the table at ``path`` and return its new version.

    Per ref the newest result stays, so that repeating a write changes nothing. Results without a repository or ref are
    rows like others. The number of buckets stays that of the first write.
    """
    spark = finalised.sparkSession
    time = finalised.schema["event_time"].dataType.simpleString()
    last = ref_version(spark, path)
    manifest = _manifests(spark, path).filter(F.col("version") == last)
    if last:
        buckets = manifest.count()
    # Combined per ref before it is used several times.
    new = stage_table(record_ref_coverage(None, finalised).withColumn("bucket", bucket_of(buckets)), "ref-results")
    touched = new.select("bucket").distinct()
    old = stored_refs(spark, path, last, time).join(F.broadcast(touched), "bucket", "left_semi")
    merged = record_ref_coverage(old, new).withColumn("bucket", bucket_of(buckets))
    version = last + 1
    data = f"{path}/data/version={version}"
    merged.repartition("bucket").sortWithinPartitions("bucket", *KEY).write.mode("overwrite").partitionBy("bucket").parquet(data)
    known = manifest.select("bucket", "data_version") if last else spark.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("data_version")
    )
    marked = known.join(F.broadcast(touched.withColumn("touched", F.lit(True))), "bucket", "left")
    marked = marked.select("bucket", F.when(F.col("touched"), F.lit(version)).otherwise(F.col("data_version")).cast("bigint").alias("data_version"))
    # One file, which appears at once when the job commits.
    marked.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return version
