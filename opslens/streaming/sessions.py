"""Session counts from a stream of entries, or by runs every five minutes that make up for runs missed.

Windows of the stream stay open for 15 minutes of late entries; every update of a window replaces its earlier count. A run counts whole windows:
the last 15 minutes again, and what the table still lacks of the last 12 hours.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P
from ..functions.names import classify_session_id, store_of_index
from ..functions.times import within
from ..operators.sessions import CATCH_UP_MS, ROW, WINDOW, as_ranges, count_entries, page_of, windows_to_count, with_coverage
from ..sources import writers as S

LATE = "15 minutes"
Ranges = list[tuple[int, int]]
_NO_COUNTS = "minute_ms bigint, source string, store string, page string, category string, value string, n bigint"


def counting_stream(entries: DataFrame, health_prefix: str, late: str = LATE) -> DataFrame:
    """Running count rows per 5-minute window; one aggregation, combined per task before the shuffle."""
    kind = classify_session_id(F.col("session_id"), health_prefix)
    test = F.when(F.col("test").isNotNull() & F.col("variant").isNotNull(), F.concat_ws(" / ", "test", "variant"))
    rows = (entries.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
            .select("at", "source", store_of_index(F.col("index")).alias("store"), page_of(F.col("page")).alias("page"),
                    kind.alias("kind"), test.alias("test_name"))
            .withColumn("row", F.explode(F.expr(
                "array_compact(array(struct('total' AS category, '' AS value), struct(kind AS category, '' AS value), "
                "CASE WHEN test_name IS NOT NULL THEN struct('variant' AS category, test_name AS value) END))"))))
    counted = rows.groupBy(F.window("at", "5 minutes"), "source", "store", "page", "row.category", "row.value").agg(
        F.count("*").alias("n"))
    return counted.select(F.unix_millis("window.start").alias("minute_ms"), *ROW[1:], "n")


def stream_counts(entries: DataFrame, health_prefix: str, table: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    def write(rows: DataFrame, batch: int) -> None:
        S.write_batch(rows.withColumn("dt", F.to_date(F.timestamp_millis("minute_ms"))), table, batch, ["dt"])
    return (counting_stream(entries, health_prefix).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start())


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    """Newest count of every window row."""
    rows = S.read_or_none(spark, table)
    if rows is None:
        return spark.createDataFrame([], _NO_COUNTS)
    return S.read_newest(rows.drop("dt"), ROW)


def read_windows(spark: SparkSession, table: str, without: int | None = None) -> DataFrame:
    """The rows of every window's last run (but one); rows that a later run no longer met are gone. Each run writes its windows' ``_all`` rows."""
    rows = S.read_or_none(spark, table)
    if rows is None:
        return spark.createDataFrame([], _NO_COUNTS)
    rows = rows if without is None else rows.filter(F.col("batch") != without)
    last = rows.filter(F.col("store") == P.ALL).groupBy("dt", "minute_ms").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["dt", "minute_ms", "batch"], "left_semi").drop("dt", "batch")


def count_run(spark: SparkSession, entries: Callable[[Ranges], DataFrame], health_prefix: str, table: str, now: int, catch_up: int = CATCH_UP_MS) -> Ranges:
    """One run: counts the windows that are due and replaces them in ``table``; the ranges counted.

    ``entries`` reads the entries of ranges, at most one for each window of ``catch_up``. The run's window is its batch: repeated, it counts the
    same ranges, whatever it wrote before, and replaces itself. A run that never ended leaves its windows to the next.
    """
    batch = now // WINDOW
    windows = windows_to_count(read_windows(spark, table, batch), now, catch_up=catch_up)
    ranges = sorted((r.start_ms, r.end_ms) for r in as_ranges(windows).collect())
    due = reduce(lambda a, b: a | b, [within("at_ms", *r) for r in ranges])
    counts = with_coverage(count_entries(entries(ranges).filter(due), health_prefix), ranges[0][0], ranges[-1][1])
    counted = reduce(lambda a, b: a | b, [within("minute_ms", *r) for r in ranges])
    rows = counts.filter(counted).withColumn("dt", F.to_date(F.timestamp_millis("minute_ms")))
    S.write_batch(rows, table, batch, ["dt"])
    return ranges
