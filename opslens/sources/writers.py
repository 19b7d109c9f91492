"""Sinks and table maintenance on plain Parquet.

Writers replace whole partitions (dynamic overwrite), so repeating one after a failure gives the same table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import DAY, HOUR, MINUTE, floor_to, within

HOUR_KEYS = ["lb", "dt", "hour"]


# ---- merging rows into a target
def upsert_newest(target: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` replace those of ``target`` with the same keys."""
    return target.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def replace_windows(target: DataFrame, fresh: DataFrame, start: int, end: int, time: str = "t") -> DataFrame:
    """Rows of [start, end) are replaced: counting a range again never doubles it."""
    return target.filter(~within(time, start, end)).unionByName(fresh.filter(within(time, start, end)))


def add_windows(target: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("t", "tenant")) -> DataFrame:
    """Rows of the same window add up in orders and covered minutes; the later document count stays."""
    both = target.unionByName(fresh)
    return both.groupBy(*keys).agg(F.sum("orders").alias("orders"), F.sum("span_min").alias("span_min"),
                                   F.max_by("docs", "at").alias("docs"), F.max("at").alias("at"),
                                   F.max_by("src", "at").alias("src"))


def add_windows_once(target: DataFrame, fresh: DataFrame, batch: int, keys: Sequence[str] = ("t", "tenant")) -> DataFrame:
    """``add_windows`` for a numbered batch: a window keeps the last batch it took (``applied``), so that a batch which is repeated adds nothing."""
    taken = target.filter(F.col("applied") >= batch).select(*keys)
    new = fresh.join(taken, list(keys), "left_anti")
    last = target.unionByName(new.withColumn("applied", F.lit(batch).cast("bigint"))).groupBy(*keys).agg(F.max("applied").alias("applied"))
    return add_windows(target.drop("applied"), new, keys).join(last, list(keys))


# ---- partitioned tables
def with_hour(rows: DataFrame, time: str = "ts_ms") -> DataFrame:
    """Partition columns of the event time: dt (date) and hour."""
    ts = F.timestamp_millis(time)
    return rows.withColumns({"dt": F.to_date(ts), "hour": F.hour(ts)})


def write_partitions(rows: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replaces exactly the partitions that ``rows`` hold.

    Rebalanced by partition: small partitions become one file, and one that holds most of the rows is
    split over many tasks.
    """
    spread = rows.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(partitions)}) */ * FROM {{rows}}", rows=rows)
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(*partitions).parquet(path))


def write_batch(rows: DataFrame, path: str, batch: int, partitions: Sequence[str] = ()) -> None:
    """Rows of one micro-batch in their own ``batch`` partition: a repeated batch replaces itself."""
    write_partitions(rows.withColumn("batch", F.lit(batch).cast("bigint")), path, [*partitions, "batch"])


# ---- small notes: files of a line, created once
def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def create_note(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file of one line unless there is one: of several writers one succeeds."""
    files, place = _place(spark, path)
    try:
        out = files.create(place, False)
    except Exception:  # noqa: BLE001  the file system says in its own way that it exists
        if files.exists(place):
            return False
        raise
    out.writeBytes(text + "\n")
    out.close()
    return True


def read_note(spark: SparkSession, path: str) -> str | None:
    """The line of a note, None without the file. A note that is being written may be empty still."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return None
    with_line = files.open(place)
    try:
        return bytes(with_line.readAllBytes()).decode().removesuffix("\n")
    finally:
        with_line.close()


def note_names(spark: SparkSession, folder: str) -> list[str]:
    files, place = _place(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if there is one."""
    files, place = _place(spark, path)
    files.delete(place, True)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether anything is at a glob."""
    files, place = _place(spark, pattern)
    return bool(files.globStatus(place))


def read_days(spark: SparkSession, path: str, days: Sequence[object]) -> DataFrame | None:
    """Some days of a table partitioned by lb and dt: only their folders are listed."""
    pattern = f"{path}/lb=*/dt={{{','.join(map(str, days))}}}"
    return spark.read.option("basePath", path).parquet(pattern) if days and matches(spark, pattern) else None


def read_newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version per key of a table written batch by batch."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
            .select(*keys, *[F.col(f"v.{c}").alias(c) for c in values]))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None while nothing was written to it (a folder without files has no schema)."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


# ---- exports
def _as_arrays(batches):
    """The lines of a task as one json array, a line at a time."""
    import pyarrow as pa
    mark = "["
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([(mark if i == 0 else ",") + x for i, x in enumerate(lines)])], ["value"])
            mark = ","
    yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], ["value"])


def export(rows: DataFrame, path: str, fmt: str) -> None:
    """Writes an export in row order over its files: csv with a header each, ndjson, or json arrays.

    Every task writes a file of its own; NULL is empty in csv and left out of json.
    """
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "ndjson":
        rows.write.mode("overwrite").json(path)
    elif fmt == "json":
        rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_as_arrays, "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError("formats are csv, json and ndjson")


def export_report(matches: DataFrame, rows: DataFrame, time: str = "log_time_ms") -> DataFrame:
    """All matching lines, the exported ones, and the first and last time in the file."""
    return rows.agg(F.count("*").alias("rows"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms")
                    ).withColumn("total", matches.agg(F.count("*")).scalar())


# ---- keeping and dropping
def kept(day: Column | str, now: int, days: int) -> Column:
    """Days that ended less than ``days`` ago; a predicate on the partition column."""
    day = F.col(day) if isinstance(day, str) else day
    return day > F.to_date(F.timestamp_millis(F.lit(now - days * DAY))) - 1


def expired_days(table: DataFrame, now: int, days: int, column: str = "dt") -> DataFrame:
    return table.filter(~kept(column, now, days)).select(column).distinct()


def drop_expired(spark: SparkSession, path: str, now: int, days: int, column: str = "dt") -> int:
    """Removes the day folders past retention from a table partitioned by day first; how many went."""
    gone = expired_days(spark.read.parquet(path), now, days, column)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    # one row per day past retention: a handful per run
    for row in gone.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={row[0]}")
        dropped += bool(folder.getFileSystem(conf).delete(folder, True))
    return dropped


# ---- conversion bookkeeping
def coverage(listed: DataFrame, ledger: DataFrame, start: int, end: int, now: int, settle_ms: int = 20 * MINUTE
             ) -> DataFrame:
    """Files per balancer and hour: listed, converted and pending. Hours that ended lately are left out.

    ``listed`` are (lb, hour_ms, path), ``ledger`` has the paths converted.
    """
    hours = listed.filter(F.col("hour_ms").between(floor_to(F.lit(start), HOUR), F.lit(end))
                          & (F.col("hour_ms") + HOUR + settle_ms <= now))
    done = ledger.select("path").distinct().withColumn("done", F.lit(1))
    return (hours.join(done, "path", "left").groupBy("lb", "hour_ms")
            .agg(F.count("*").alias("files"), F.count("done").alias("converted"))
            .withColumn("pending", F.col("files") - F.col("converted")))


def pending_files(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed files that are not in the ledger."""
    return listed.join(ledger.select("path"), "path", "left_anti")
