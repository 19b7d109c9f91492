"""Readers of the operational data sets."""
from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import patterns as P
from ..functions.times import HOUR, within
from .schemas import read_widened

# The column layouts of the CSV data sets.
METRIC_SCHEMA = ("minute string, api string, stage string, calls bigint, err_4xx bigint, err_5xx bigint, "
                 "latency_p50_ms double, latency_p95_ms double, integration_p95_ms double")
INBOUND_SCHEMA = "minute string, tenant string, orders bigint, docs bigint, span_min bigint, src string"
COUNT_SCHEMA = ("minute string, source string, store string, page string, category string, value string, "
                "count bigint")
ID_SCHEMA = ("minute string, source string, store string, page string, category string, session_id string, "
             "order_id string, doc_id string, at string")
MINUTE_FORMAT = "yyyy-MM-dd'T'HH:mmX"

Range = tuple[int, int]
#: conditions of a scan that finds no file
NOTHING_THERE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def _hour_text(ms: int) -> tuple[str, int]:
    when = datetime.fromtimestamp(ms / 1000, timezone.utc)
    return when.strftime("%Y-%m-%d"), when.hour


def hour_partitions(start_ms: int, end_ms: int) -> Column:
    """Partition predicate for the hours from the start's to the end's, both included.

    Compares the partition columns with literals, so Spark lists and reads those folders only.
    """
    (d0, h0), (d1, h1) = _hour_text(start_ms), _hour_text(end_ms)
    day, hour = F.col("dt").cast("date"), F.col("hour").cast("int")
    first, last = F.lit(d0).cast("date"), F.lit(d1).cast("date")
    return ((day >= first) & (day <= last) & ((day > first) | (hour >= h0)) & ((day < last) | (hour <= h1)))


def hour_folders(start_ms: int, end_ms: int) -> str:
    """Path glob of the hour folders a range touches."""
    days: dict[str, list[str]] = {}
    for ms in range(start_ms // HOUR * HOUR, end_ms + 1, HOUR):
        day, hour = _hour_text(ms)
        days.setdefault(day, []).append(f"{hour:02d}")
    return "{" + ",".join(f"dt={d}/hour={{{','.join(hours)}}}" for d, hours in days.items()) + "}"


def read_logs(spark: SparkSession, root: str, cluster: str, start_ms: int, end_ms: int) -> DataFrame:
    """Log lines of one cluster's hours (``cluster/dt=…/hour=…``), columns joined by name over the files.

    The folders are named by a glob, so joining the schemas reads the footers of those hours only. Hours without a
    folder have no lines; a range without any gives an empty frame. A column of several types is read in one that holds
    them all; the frame then has the columns ``_file`` and ``_row`` besides.
    """
    folder = f"{root.rstrip('/')}/{cluster}"
    reader, hours = spark.read.option("mergeSchema", "true").option("basePath", folder), f"{folder}/{hour_folders(start_ms, end_ms)}"
    try:
        logs = reader.parquet(hours)
    except Exception as e:  # noqa: BLE001  a conflict of types comes from the driver or from a task, in different classes
        if isinstance(e, AnalysisException) and e.getCondition() in NOTHING_THERE:
            return spark.createDataFrame([], "log_time_ms bigint, dt date, hour int")
        if "CANNOT_MERGE" not in str(e) and "Failed to merge" not in str(e):
            raise
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(hours).select("path")
        logs = read_widened(spark, sorted(r.path for r in files.collect()), folder)
    return logs.filter(hour_partitions(start_ms, end_ms))


def list_clusters(logs: DataFrame) -> DataFrame:
    """Valid cluster names of log lines, sorted."""
    return logs.select("cluster").filter(F.col("cluster").rlike(P.CLUSTER_NAME)).distinct().orderBy("cluster")


def list_cluster_folders(spark: SparkSession, root: str) -> list[str]:
    """Valid cluster names under a log root, sorted; only the folder is listed, no file is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []
    return sorted(n for n in names if re.fullmatch(P.CLUSTER_NAME.strip("^$"), n))


def read_access_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Non-empty raw lines with the file they came from. A gz file is one task: many small files spread."""
    lines = spark.read.text(list(paths), recursiveFileLookup=True)
    return lines.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file")).filter("raw <> ''")


def has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether anything is at a path or glob."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def _in_ranges(t: Column, ranges: Sequence[Range]) -> Column:
    return reduce(lambda a, b: a | b, [within(t, *r) for r in ranges])


def _timed_csv(spark: SparkSession, paths: Sequence[str], schema: str, ranges: Sequence[Range] | None,
               **options: str) -> DataFrame:
    there = [p for p in paths if has_files(spark, p)]
    rows = spark.read.csv(there, schema=schema, header=True, recursiveFileLookup=True, **options) if there else spark.createDataFrame([], schema)
    rows = rows.withColumn("t", F.unix_millis(F.try_to_timestamp("minute", F.lit(MINUTE_FORMAT))))
    return rows.filter(_in_ranges(F.col("t"), ranges)) if ranges else rows


def block_days(root: str, ranges: Sequence[Range]) -> list[str]:
    """The day folders of 4-hour block files that ranges touch."""
    days = {_hour_text(ms)[0] for a, b in ranges for ms in [*range(a, b, HOUR), b - 1]}
    return [f"{root.rstrip('/')}/dt={d}" for d in sorted(days)]


def read_api_metrics(spark: SparkSession, paths: Sequence[str], ranges: Sequence[Range] | None = None) -> DataFrame:
    """API metric minutes; counts that are missing are 0."""
    rows = _timed_csv(spark, paths, METRIC_SCHEMA, ranges)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "err_4xx", "err_5xx")]
    return rows.select("t", "api", "stage", *counts, F.col("latency_p50_ms").alias("p50"),
                       F.col("latency_p95_ms").alias("p95"), F.col("integration_p95_ms").alias("ip95"))


def read_inbound(spark: SparkSession, sources: Sequence[Sequence[str]],
                 ranges: Sequence[Range] | None = None) -> DataFrame:
    """Inbound windows of several clusters; ``source`` tells which one counted the row."""
    parts = [_timed_csv(spark, paths, INBOUND_SCHEMA, ranges).withColumn("source", F.lit(i))
             for i, paths in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts).withColumn("orders", F.coalesce("orders", F.lit(0)))


def read_session_counts(spark: SparkSession, paths: Sequence[str], ranges: Sequence[Range] | None = None) -> DataFrame:
    """Session count rows; an empty text is a value, not NULL."""
    rows = _timed_csv(spark, paths, COUNT_SCHEMA, ranges, nullValue="\u0001", emptyValue="")
    return rows.select(F.col("t").alias("minute_ms"), "source", "store", F.coalesce("page", F.lit("")).alias("page"),
                       "category", F.coalesce("value", F.lit("")).alias("value"),
                       F.coalesce("count", F.lit(0)).alias("n"))


def read_session_ids(spark: SparkSession, paths: Sequence[str], ranges: Sequence[Range] | None = None) -> DataFrame:
    return _timed_csv(spark, paths, ID_SCHEMA, ranges, nullValue="\u0001", emptyValue="")
