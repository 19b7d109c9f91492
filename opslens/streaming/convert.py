"""Access log conversion as a stream of files or over a range, every file once, with exact re-merging of late ones.

Tables under one root:

``numbers``, ``names``  a file per batch: the store's own batch numbers, one for each micro-batch or range
``incoming``  request rows by lb, dt, hour, batch: what each batch brought
``arrived``   (lb, dt, hour, n) per batch: which hours a batch touched
``ledger``    files converted, per batch
``failed``    (path, error, tries, next_ms) per batch: files that could not be read, and when they are tried again
``requests``, ``paths``, ``minutes``  finished hours and their roll-ups, by lb, dt, hour, upto
``merged``    (lb, dt, hour, upto) per merge
``minutes_by_hour``, ``minutes_by_day``, ``paths_by_hour``, ``paths_by_day``  roll-ups of ended days in longer steps, by lb, dt, version
``rolled``    (lb, dt, version) per roll-up of days
``finished``, ``generations``, ``base``  batches that are done, and the small tables put together (see ``generations``)

An hour is merged some minutes after it ends, and merged again as a whole when a late file touches it. A merge of the batches up to a number
writes partitions of that number, and the marker in ``merged`` is written last: readers look only at the newest marked number of an
hour, so that the three tables and the rows not merged yet all switch at once, and a merge that is repeated replaces itself.

A day's version is a hash of its hours and the number each is merged up to. Roll-ups of longer steps count only while the version they were made
from is the day's: once a late file merges an hour again, the day is answered by its minutes until it is rolled up anew.
"""
from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import DAY, HOUR, MINUTE
from ..operators.access import coarser, minute_rollup, parse_requests, path_rollup
from ..operators.lb import LongSteps, RequestTables
from ..sources import writers as S
from . import generations

SETTLE_MS = 15 * MINUTE
DAY_KEYS = ["lb", "dt", "version"]
#: how long a file that could not be read is left alone
RETRY_MS = 30 * MINUTE


@dataclass(frozen=True)
class RequestStore:
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        return generations.read(spark, self, name) if name in generations.SMALL else S.read_or_none(spark, self.path(name))

    def name_note(self, name: str) -> str:
        return self.path(f"names/{hashlib.sha256(name.encode()).hexdigest()}")

    # -- conversion
    def batch_of(self, spark: SparkSession, name: str) -> int:
        """The store's number of a batch: the one it was given before, or else a new one.

        A number is taken by creating its file, which fails if there is one: two writers never get the same. What was taken for a name is then
        written under the name in the same way.
        """
        named = self.name_note(name)
        known = S.read_note(spark, named)
        if known is None:
            batch = 1 + max([int(n) for n in S.note_names(spark, self.path("numbers"))], default=-1)
            while not S.create_note(spark, self.path(f"numbers/{batch}"), name):
                batch += 1
            known = str(batch) if S.create_note(spark, named, str(batch)) else S.read_note(spark, named)
        return int(known)

    def converted(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """Files that other batches hold."""
        ledger = self.read(spark, "ledger")
        return None if ledger is None else ledger.filter(F.col("batch") != batch).select(F.col("path").alias("file"))

    def add(self, lines: DataFrame, batch: int, files: DataFrame | None = None) -> None:
        """Parse one batch of (raw, file) lines; ``files`` (path) are those it stands for. A batch that is repeated replaces what it wrote.

        The lines are read once: which hours they touch is counted from the rows written.
        """
        rows = S.with_hour(parse_requests(lines)).filter("lb IS NOT NULL AND ts_ms IS NOT NULL")
        S.write_batch(rows, self.path("incoming"), batch, S.HOUR_KEYS)
        spark = lines.sparkSession
        incoming = self.read(spark, "incoming")
        if incoming is not None:
            own = incoming.filter(F.col("batch") == batch)
            S.write_batch(own.groupBy(*S.HOUR_KEYS).agg(F.count("*").alias("n")), self.path("arrived"), batch)
        files = lines.select(F.col("file").alias("path")).distinct() if files is None else files
        S.write_batch(files, self.path("ledger"), batch)

    def failures(self, spark: SparkSession) -> DataFrame | None:
        """(path, error, tries, next_ms) of files that could not be read and have not been converted since."""
        failed, ledger = self.read(spark, "failed"), self.read(spark, "ledger")
        if failed is None:
            return None
        last = S.read_newest(failed, ["path"])
        return last if ledger is None else last.join(ledger.select("path"), "path", "left_anti")

    def done(self, spark: SparkSession) -> DataFrame | None:
        """(lb, dt, hour, done): up to which batch an hour is merged."""
        merged = self.read(spark, "merged")
        return None if merged is None else merged.groupBy(*S.HOUR_KEYS).agg(F.max("upto").alias("done"))

    def waiting(self, spark: SparkSession) -> DataFrame | None:
        """(lb, dt, hour, batch) that arrived and isn't merged yet."""
        arrived, done = self.read(spark, "arrived"), self.done(spark)
        if arrived is None or done is None:
            return None if arrived is None else arrived.select(*S.HOUR_KEYS, "batch")
        return arrived.join(done, S.HOUR_KEYS, "left").filter("done IS NULL OR batch > done").select(*S.HOUR_KEYS, "batch")

    def merge(self, spark: SparkSession, now: int, batch: int) -> None:
        """Rebuild every ended hour with rows not merged yet: requests, paths, minutes, and the marker last.

        The list of hours is written first; read back, its size is known, so the scans are pruned to those partitions.
        """
        waiting = self.waiting(spark)
        if waiting is None:
            return
        start = F.unix_millis(F.col("dt").cast("timestamp")) + F.col("hour") * HOUR
        due = waiting.filter(start + HOUR + SETTLE_MS <= now).groupBy(*S.HOUR_KEYS).agg(F.max("batch").alias("upto"))
        S.write_batch(due, self.path("due"), batch)
        hours = self.read(spark, "due")
        hours = None if hours is None else hours.filter(F.col("batch") == batch).drop("batch")
        if hours is None or hours.isEmpty():
            return
        keys = [*S.HOUR_KEYS, "upto"]
        rows = self.incoming(spark, hours).join(hours, S.HOUR_KEYS).filter("batch <= upto").drop("batch")
        S.write_partitions(rows, self.path("requests"), keys)
        merged = spark.read.parquet(self.path("requests")).join(hours, keys, "left_semi")
        for name, rollup in (("paths", path_rollup), ("minutes", minute_rollup)):
            rolled = S.with_hour(rollup(merged), "minute_ms").join(hours, S.HOUR_KEYS)
            S.write_partitions(rolled, self.path(name), keys)
        S.write_batch(hours.select(*keys), self.path("merged"), batch)

    def versions(self, spark: SparkSession) -> DataFrame | None:
        """(lb, dt, version): what a day with finished hours consists of."""
        done = self.done(spark)
        hours = F.to_json(F.sort_array(F.collect_list(F.struct("hour", "done"))))       # 24 at most
        return None if done is None else done.groupBy("lb", "dt").agg(F.concat(F.lit("v"), F.sha2(hours, 256)).alias("version"))

    def rolled(self, spark: SparkSession) -> DataFrame | None:
        """(lb, dt, version) of days whose roll-ups in longer steps are up to date."""
        rolled = self.read(spark, "rolled")
        return None if rolled is None else self.versions(spark).join(rolled, DAY_KEYS, "left_semi")

    def roll_days(self, spark: SparkSession, now: int) -> None:
        """Roll up every ended day whose longer steps aren't up to date, and the marker last. Without such days nothing is written.

        The hours and numbers a version stands for are written first and then read exactly so, whatever is merged meanwhile. Run again after a
        failure, it replaces what it wrote.
        """
        versions, rolled, done = self.versions(spark), self.rolled(spark), self.done(spark)
        if versions is None:
            return
        days = versions.filter(F.unix_millis(F.col("dt").cast("timestamp")) + DAY + SETTLE_MS <= now)
        if rolled is not None:
            days = days.join(rolled, DAY_KEYS, "left_anti")
        if days.isEmpty():
            return
        batch = self.batch_of(spark, f"days/{uuid.uuid4()}")
        S.write_batch(done.withColumnRenamed("done", "upto").join(days, ["lb", "dt"]), self.path("due_days"), batch)
        hours = self.read(spark, "due_days").filter(F.col("batch") == batch).drop("batch")
        for name in ("minutes", "paths"):
            rows = spark.read.parquet(self.path(name)).join(hours, [*S.HOUR_KEYS, "upto"]).drop("hour", "upto")
            S.write_partitions(coarser(rows, HOUR), self.path(f"{name}_by_hour"), DAY_KEYS)
            by_hour = spark.read.parquet(self.path(f"{name}_by_hour")).join(hours, DAY_KEYS, "left_semi")
            S.write_partitions(coarser(by_hour, DAY), self.path(f"{name}_by_day"), DAY_KEYS)
        S.write_batch(hours.select(*DAY_KEYS).distinct(), self.path("rolled"), batch)
        generations.finish(spark, self, batch)

    # -- reading
    def incoming(self, spark: SparkSession, hours: DataFrame) -> DataFrame | None:
        """What batches brought on the days of ``hours``, whose dates come to the driver: the other days' folders aren't listed."""
        return S.read_days(spark, self.path("incoming"), [r.dt for r in hours.select("dt").distinct().collect()])

    def unmerged(self, spark: SparkSession) -> DataFrame | None:
        """Rows of hours not merged yet, and late rows of merged hours; only their partitions are read."""
        waiting = self.waiting(spark)
        if waiting is None:
            return self.read(spark, "incoming")
        rows = self.incoming(spark, waiting)
        if rows is None:                                         # nothing waits: any day tells the columns
            root = self.path("incoming")
            days = [d.removeprefix("dt=") for lb in S.note_names(spark, root)[:1] for d in S.note_names(spark, f"{root}/{lb}")[:1]]
            rows = S.read_days(spark, root, days)
            return None if rows is None else rows.limit(0)
        return rows.join(waiting, [*S.HOUR_KEYS, "batch"], "left_semi")

    def current(self, spark: SparkSession, name: str, without: DataFrame | None = None) -> DataFrame | None:
        """The newest marked version of every finished hour, those of the days in ``without`` left out."""
        rows, done = self.read(spark, name), self.done(spark)
        if rows is None or done is None:
            return None
        done = done if without is None else done.join(without, ["lb", "dt"], "left_anti")
        return rows.join(done.withColumnRenamed("done", "upto"), [*S.HOUR_KEYS, "upto"], "left_semi").drop("dt", "hour", "upto")

    def long_steps(self, spark: SparkSession, name: str) -> LongSteps | None:
        """Roll-ups by hour and day of the days that have one up to date, and the minutes of the others."""
        rolled = self.rolled(spark)
        if rolled is None:
            return None
        by_hour, by_day = (self.read(spark, f"{name}_by_{step}") for step in ("hour", "day"))
        if by_hour is None or by_day is None:                    # no day's are up to date, and the old ones are removed
            return None
        return LongSteps(*[rows.join(rolled, DAY_KEYS, "left_semi").drop("dt", "version") for rows in (by_hour, by_day)], self.current(spark, name, rolled))

    def tables(self, spark: SparkSession) -> RequestTables:
        """What queries read: finished hours, their roll-ups, and the rest as rows."""
        rest = self.unmerged(spark)
        rest = None if rest is None else rest.drop("dt", "hour", "batch")
        parts = [self.current(spark, n) for n in ("requests", "minutes", "paths")]
        if any(p is None for p in parts):
            empty = rest.limit(0)
            parts = [empty, minute_rollup(empty), path_rollup(empty)]
        return RequestTables(*parts, rest, self.long_steps(spark, "minutes"), self.long_steps(spark, "paths"))


def readable(spark: SparkSession, files: list[str], problem: str = "") -> tuple[list[str], list[tuple[str, str]]]:
    """``files`` that can be read to their end, and (file, error) of the others, found by halving: some jobs per file that can't be."""
    from ..sources.readers import read_access_lines
    if not files:
        return [], []
    try:
        read_access_lines(spark, *files).agg(F.sum(F.length("raw"))).collect()
        return files, []
    except Exception as e:  # noqa: BLE001  whatever a file's reader throws
        problem = str(e).splitlines()[0][:200]
    if len(files) == 1:
        return [], [(files[0], problem)]
    half = len(files) // 2
    (good, bad), (more, worse) = readable(spark, files[:half]), readable(spark, files[half:])
    return good + more, bad + worse


def convert_files(spark: SparkSession, store: RequestStore, files: list[str], name: str, now: int) -> int:
    """One named batch of files without those that other batches hold; how many were converted. Repeated under its name, it replaces itself.

    Once it is finished, it isn't done again.
    A file that can't be read is set aside with the time of its next try, and the rest of the batch goes on. File names come to the driver, as they do for any scan.
    """
    from ..sources.readers import read_access_lines
    batch = store.batch_of(spark, name)
    if generations.is_finished(spark, store, batch):
        return 0
    other = store.converted(spark, batch)
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    if other is not None and files:
        files = sorted(r.path for r in listed.join(other.withColumnRenamed("file", "path"), "path", "left_anti").collect())

    def add(good: list[str]) -> None:
        lines = read_access_lines(spark, *good) if good else spark.createDataFrame([], "raw string, file string")
        store.add(lines, batch, spark.createDataFrame([(f,) for f in good], "path string"))
    try:
        add(files)
    except Exception:  # noqa: BLE001
        files, bad = readable(spark, files)
        if not bad:
            raise
        before = store.read(spark, "failed")
        tries = {} if before is None else {r.path: r.n for r in before.filter(F.col("path").isin([f for f, _ in bad]) & (F.col("batch") != batch)).groupBy("path").agg(F.max("tries").alias("n")).collect()}
        rows = [(f, error, tries.get(f, 0) + 1, now + RETRY_MS) for f, error in bad]
        S.write_batch(spark.createDataFrame(rows, "path string, error string, tries int, next_ms bigint"), store.path("failed"), batch)
        add(files)
    store.merge(spark, now, batch)
    generations.finish(spark, store, batch)
    return len(files)


def retry_failed(spark: SparkSession, store: RequestStore, now: int) -> int:
    """Tries files that were set aside and are due, as a batch of their own; how many came in."""
    failures = store.failures(spark)
    due = [] if failures is None else sorted((r.path, r.tries) for r in failures.filter(F.col("next_ms") <= now).collect())
    if not due:
        return 0
    name = hashlib.sha256("\n".join(f"{p} {n}" for p, n in due).encode()).hexdigest()
    return convert_files(spark, store, [p for p, _ in due], f"retry/{name}", now)


def stream_convert(spark: SparkSession, source: str, store: RequestStore, checkpoint: str, now: int | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """New log files every five minutes by default.

    The stream brings names of files, which are then read once. A batch is named by the checkpoint's own id and its number, so that a repeated one is known again and
    those of a new checkpoint are not taken for old ones; the ledger keeps files out that were converted before. Each batch also tries files that were
    set aside and are due; ``retry_failed`` does so where no new files come. Days that ended are rolled up by hour and day. Every 50 batches the
    store's small tables are put together, and what was replaced an hour ago is removed.
    """
    import json
    import time
    listed = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
              .option("recursiveFileLookup", "true").load(source).select("path"))

    def convert(batch_files: DataFrame, batch: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
        time_ms = int(time.time() * 1000) if now is None else now
        convert_files(spark, store, sorted({r.path for r in batch_files.collect()}), f"{query}/{batch}", time_ms)
        retry_failed(spark, store, time_ms)
        store.roll_days(spark, time_ms)
        if generations.compact(spark, store, time_ms):
            generations.collect(spark, store, time_ms)
    return (listed.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 minutes"})).start())


def convert_range(spark: SparkSession, paths: list[str], store: RequestStore, now: int) -> int:
    """The same conversion for chosen old files, as one batch named by the files that are not converted yet; how many came in.

    A range converted before, by a stream or a range, changes nothing; files set aside wait for their time. Days it touches are answered by
    their minutes until ``RequestStore.roll_days`` runs.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    for known in (store.read(spark, "ledger"), store.failures(spark)):
        if known is not None:
            listed = listed.join((known.filter(F.col("next_ms") > now) if "next_ms" in known.columns else known).select("path"), "path", "left_anti")
    files = sorted(r.path for r in listed.distinct().collect())
    if not files:
        return 0
    tries = f"{now // RETRY_MS}" if store.failures(spark) is not None else ""
    name = hashlib.sha256("\n".join([*files, tries]).encode()).hexdigest()
    return convert_files(spark, store, files, f"range/{name}", now)
