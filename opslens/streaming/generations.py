"""Compaction of the request store's small tables, and removal of what is no longer read.

Each batch writes a folder of its own to the tables of ``SMALL``, so that a read would list one folder a batch for ever. A generation holds the rows of
all batches that are finished, a few files a table, and what of them still says something: hours not merged yet, the newest merge of an hour, days whose
longer steps are up to date, files that still fail. Its note under ``generations`` is created last and switches all tables at once; a reader takes the
newest readable note, the rows of its generation, and the folders of the batches it doesn't cover. Batches taken but not finished by then (running, or
lost in a crash) stay outside as ``open``, however old.

What a generation replaced is removed only once the note is ``KEEP_MS`` old, so that queries planned before it finish. Each step can be repeated:
a compaction that ends before its note changes nothing, and a removal that ends early goes on the next time.
"""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import HOUR
from ..sources import writers as S

if TYPE_CHECKING:
    from .convert import RequestStore

#: tables of rows that later batches look up, and tables that only their own batch reads
SMALL, OWN = ("arrived", "ledger", "failed", "merged", "rolled"), ("due", "due_days")
KEEP_MS = HOUR
#: finished batches that make a compaction worth while
LEAST = 50


@dataclass(frozen=True)
class Generation:
    """The batches up to a number, those still open left out."""
    number: int
    token: str
    upto: int
    open: tuple[int, ...]
    ms: int

    def covers(self, batch: int) -> bool:
        return batch <= self.upto and batch not in self.open

    def covered(self) -> Column:
        return (F.col("batch") <= self.upto) & ~F.col("batch").isin(*self.open)

    def path(self, store: RequestStore, name: str = "") -> str:
        return store.path(f"base/{self.token}/{name}").rstrip("/")


def generations(spark: SparkSession, store: RequestStore) -> list[Generation]:
    """All that are complete, oldest first. A note that is being written doesn't count yet."""
    found = []
    for number in sorted(int(n) for n in S.note_names(spark, store.path("generations"))):
        try:
            note = json.loads(S.read_note(spark, store.path(f"generations/{number}")) or "")
        except ValueError:
            continue
        found.append(Generation(number, note["token"], note["upto"], tuple(note["open"]), note["ms"]))
    return found


def read(spark: SparkSession, store: RequestStore, name: str) -> DataFrame | None:
    """A small table: the newest generation's rows and the batches it doesn't cover."""
    rows, last = S.read_or_none(spark, store.path(name)), generations(spark, store)[-1:]
    if rows is not None:
        rows = (rows.filter(~last[0].covered()) if last else rows).withColumn("batch", F.col("batch").cast("bigint"))
    base = S.read_or_none(spark, last[0].path(store, name)) if last else None
    return rows if base is None else base if rows is None else base.unionByName(rows)


def finish(spark: SparkSession, store: RequestStore, batch: int) -> None:
    """Notes that a batch has written all it will write."""
    S.create_note(spark, store.path(f"finished/{batch}"), "")


def is_finished(spark: SparkSession, store: RequestStore, batch: int) -> bool:
    return S.exists(spark, store.path(f"finished/{batch}")) or any(g.covers(batch) for g in generations(spark, store)[-1:])


def _contents(spark: SparkSession, store: RequestStore, covered: Column) -> dict[str, DataFrame]:
    """What a generation holds: each table's rows of covered batches that still count, and the versions those replaced."""
    hours, day = S.HOUR_KEYS, ["lb", "dt", "version"]
    tables = {n: rows.filter(covered) for n in SMALL if (rows := store.read(spark, n)) is not None}
    if "arrived" in tables:
        tables["arrived"] = tables["arrived"].join(store.waiting(spark), [*hours, "batch"], "left_semi")
    if "failed" in tables:
        last = F.max_by(F.struct("error", "tries", "next_ms", "batch"), "batch")
        tables["failed"] = tables["failed"].groupBy("path").agg(last.alias("v")).select("path", "v.*").join(store.failures(spark).select("path"), "path", "left_semi")
    if "merged" in tables:
        marked = tables["merged"]
        newest = marked.groupBy(*hours).agg(F.max("upto").alias("newest"))
        tables["merged"] = marked.groupBy(*hours).agg(F.max("upto").alias("upto"), F.max("batch").alias("batch"))
        tables["old_hours"] = marked.join(newest, hours).filter("upto < newest").select(*hours, "upto").distinct()
    if "rolled" in tables:
        marked, current = tables["rolled"], store.versions(spark)
        tables["rolled"] = marked.join(current, day, "left_semi")
        tables["old_days"] = marked.join(current, day, "left_anti").select(*day).distinct()
    return tables


def compact(spark: SparkSession, store: RequestStore, now: int, least: int = LEAST) -> bool:
    """Writes a generation if at least ``least`` batches finished since the last one; whether it did. Of two at a time one counts."""
    # a batch's number is taken after all smaller ones: reading the finished first, none of those is overlooked
    finished = {int(n) for n in S.note_names(spark, store.path("finished"))}
    taken = {int(n) for n in S.note_names(spark, store.path("numbers"))}
    last = generations(spark, store)[-1:]
    fresh = {b for b in finished if not any(g.covers(b) for g in last)}
    if len(fresh) < max(least, 1):
        return False
    upto = max([*fresh, *[g.upto for g in last]])
    still_open = tuple(sorted(b for b in taken if b < upto and b not in finished and not any(g.covers(b) for g in last)))
    number = 1 + max([int(n) for n in S.note_names(spark, store.path("generations"))], default=-1)
    new = Generation(number, uuid.uuid4().hex, upto, still_open, now)
    for name, rows in _contents(spark, store, new.covered()).items():
        spark.sql("SELECT /*+ REBALANCE */ * FROM {rows}", rows=rows).write.parquet(new.path(store, name))
    note = json.dumps({"token": new.token, "upto": upto, "open": still_open, "ms": now})
    if S.create_note(spark, store.path(f"generations/{number}"), note):
        return True
    S.remove(spark, new.path(store))
    return False


def _remove_versions(spark: SparkSession, store: RequestStore, old: DataFrame | None, keys: list[str], tables: tuple[str, ...]) -> None:
    """Removes the partition folders of replaced versions. Only the days concerned are listed; a folder's name comes to the driver, no row."""
    days = [] if old is None else [r.dt for r in old.select("dt").distinct().collect()]
    texts = [F.col(k).cast("string").alias(k) for k in keys]
    for name in tables if days else ():
        root = store.path(name)
        pattern = f"{root}/lb=*/dt={{{','.join(map(str, days))}}}"
        if S.matches(spark, pattern):
            files = spark.read.format("binaryFile").option("basePath", root).option("pathGlobFilter", "*.parquet").load(pattern).select("path", *texts)
            folders = files.join(old.select(*texts), keys, "left_semi").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
            for r in folders.toLocalIterator():
                S.remove(spark, r.folder)


def collect(spark: SparkSession, store: RequestStore, now: int, keep_ms: int = KEEP_MS) -> None:
    """Removes what generations at least ``keep_ms`` old have replaced."""
    due = [g for g in generations(spark, store) if g.ms <= now - keep_ms]
    for g in due:
        for name, keys, tables in (("old_hours", [*S.HOUR_KEYS, "upto"], ("requests", "minutes", "paths")),
                                   ("old_days", ["lb", "dt", "version"], tuple(f"{t}_by_{step}" for t in ("minutes", "paths") for step in ("hour", "day")))):
            _remove_versions(spark, store, S.read_or_none(spark, g.path(store, name)), keys, tables)
            S.remove(spark, g.path(store, name))
    if not due:
        return
    last = due[-1]
    for name in (*SMALL, *OWN):
        for folder in S.note_names(spark, store.path(name)):
            if folder.startswith("batch=") and last.covers(int(folder.removeprefix("batch="))):
                S.remove(spark, store.path(f"{name}/{folder}"))
    taken = sorted(int(n) for n in S.note_names(spark, store.path("numbers")))
    for batch in taken[:-1]:                                     # the greatest number tells the next one
        if last.covers(batch):
            named = store.name_note(S.read_note(spark, store.path(f"numbers/{batch}")) or "")
            if S.read_note(spark, named) == str(batch):
                S.remove(spark, named)
            S.remove(spark, store.path(f"numbers/{batch}"))
    for batch in S.note_names(spark, store.path("finished")):
        if last.covers(int(batch)):
            S.remove(spark, store.path(f"finished/{batch}"))
    for g in due[:-1]:
        S.remove(spark, g.path(store))
        S.remove(spark, store.path(f"generations/{g.number}"))
