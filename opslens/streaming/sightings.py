"""First sightings of orders from a stream.

Arrival order is not time order, so a state store that keeps the first arrival would be wrong. Each
batch writes its own minima per UTC day; a minimum of minima is exact whatever the batches, and a day is
folded into one final partition once it is closed.

``CountedOrders`` keeps one such table per service and definition (which lines announce an order): a changed definition counts the days anew
into a table of its own, and a marker, written last, makes readers switch.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import DAY, HOUR, within
from ..operators.orders import KEY, OrderLine, extract_orders, first_seen_by_utc_day
from ..sources import writers as S

FINAL_AFTER_MS = 3 * HOUR
#: the batch that holds what a recount found; batches of streams count from 0
RECOUNT = -1
SEEN = "day date, service string, store string, order_id string, first_ms bigint"


def add_batch(sightings: DataFrame, root: str, batch: int) -> None:
    S.write_batch(first_seen_by_utc_day(sightings), f"{root}/open", batch, ["day"])


def read_first_seen(spark: SparkSession, root: str) -> DataFrame:
    """(day, service, store, order_id, first_ms): final days as they are, open days merged."""
    parts = [p.drop("batch") for p in (S.read_or_none(spark, f"{root}/final"), S.read_or_none(spark, f"{root}/open"))
             if p is not None]
    if not parts:
        return spark.createDataFrame([], SEEN)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("day", *KEY).agg(F.min("first_ms").alias("first_ms"))


def close_days(spark: SparkSession, root: str, now: int) -> None:
    """Fold days that ended some hours ago into one partition each, and again those that late rows have changed since. Running it again changes nothing."""
    arrived, final = S.read_or_none(spark, f"{root}/open"), S.read_or_none(spark, f"{root}/final")
    if arrived is None:
        return
    if final is not None:
        known = final.select("day", *KEY, F.col("first_ms").alias("known_ms"))
        arrived = arrived.join(known, ["day", *KEY], "left").filter("known_ms IS NULL OR first_ms < known_ms")
    start = F.unix_millis(F.col("day").cast("timestamp"))
    days = read_first_seen(spark, root).filter(start + DAY + FINAL_AFTER_MS < now).join(arrived.select("day").distinct(), "day", "left_semi")
    S.write_partitions(days, f"{root}/final", ["day"])


def stream_first_seen(sightings: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                      prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """``sightings`` is a stream of (service, store, order_id, ms); ``prepare`` may turn log lines into them."""
    def write(rows: DataFrame, batch: int) -> None:
        add_batch(prepare(rows) if prepare else rows, root, batch)
    return (sightings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 minutes"})).start())


@dataclass(frozen=True)
class OrderService:
    """A service whose log lines announce orders: its cluster and the lines, and the names of tenants."""
    name: str
    cluster: str
    lines: Sequence[OrderLine]
    tenants: Mapping[str, str] = field(default_factory=dict)

    @property
    def version(self) -> str:
        """A hash of everything the counts depend on; the order of ``skip``, ``groups`` and ``tenants`` doesn't matter."""
        lines = [[x.contains, x.regex, sorted(x.groups.items()), sorted((k, sorted(v)) for k, v in x.skip.items())] for x in self.lines]
        return hashlib.sha256(json.dumps([self.cluster, lines, sorted(self.tenants.items())]).encode()).hexdigest()[:16]

    def orders(self, logs: DataFrame) -> DataFrame:
        return extract_orders(logs, self.name, self.lines, self.tenants)


@dataclass(frozen=True)
class CountedOrders:
    """First sightings of orders per service, in the definition each day was counted by.

    ``<service>/<version>`` holds a definition's days as above; ``<service>/marks`` a file per switch: its version and the first day it
    speaks for. A day belongs to the last switch that reaches back to it, so days before a recount keep their old counts.
    """
    root: str

    def folder(self, service: str, version: str) -> str:
        return f"{self.root.rstrip('/')}/{quote(service, safe='')}/{version}"

    def switches(self, spark: SparkSession, service: str) -> list[tuple[str, date]]:
        """(version, first day) of every switch, the first one first: one per change of the configuration."""
        folder = self.folder(service, "marks")
        notes = [S.read_note(spark, f"{folder}/{n}") for n in sorted(S.note_names(spark, folder), key=int)]
        return [(version, date.fromisoformat(day)) for version, day in (n.split() for n in notes)]

    def stale(self, spark: SparkSession, services: Sequence[OrderService]) -> list[OrderService]:
        """Services that are not counted yet, or by another definition."""
        return [s for s in services if [v for v, _ in self.switches(spark, s.name)][-1:] != [s.version]]

    def add(self, service: OrderService, logs: DataFrame, batch: int) -> None:
        """One micro-batch of the service's log lines, under the service's own definition; readers see it once that is switched to."""
        add_batch(service.orders(logs), self.folder(service.name, service.version), batch)

    def recount(self, service: OrderService, logs: DataFrame, first: date, last: date) -> None:
        """Count the UTC days ``first`` to ``last`` out of ``logs`` by the service's definition, then switch to it.

        A stream of the new definition may already run: sightings found by both have the same minimum. Readers see the old counts until the end,
        and a recount that is repeated after a failure replaces itself.
        """
        spark = logs.sparkSession
        start, end = ((d - date(1970, 1, 1)).days * DAY for d in (first, last))
        found = service.orders(logs.filter(within("log_time_ms", start, end + DAY)))
        add_batch(found, self.folder(service.name, service.version), RECOUNT)
        known = self.switches(spark, service.name)
        if known and known[-1][0] == service.version and known[-1][1] <= first:
            return
        number = len(known)
        while not S.create_note(spark, f"{self.folder(service.name, 'marks')}/{number}", f"{service.version} {first.isoformat()}"):
            number += 1

    def read(self, spark: SparkSession, services: Sequence[str]) -> DataFrame:
        """(day, service, store, order_id, first_ms) of the named services; one that is no longer configured is left out by not naming it."""
        parts = []
        for service in services:
            until = None
            for version, first in reversed(self.switches(spark, service)):
                if until is None or first < until:
                    mine = F.col("day") >= F.lit(first)
                    rows = read_first_seen(spark, self.folder(service, version))
                    parts.append(rows.filter(mine if until is None else mine & (F.col("day") < F.lit(until))))
                    until = first
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SEEN)

    def close(self, spark: SparkSession, services: Sequence[OrderService], now: int) -> None:
        """Fold the ended days of every service's own definition."""
        for service in services:
            close_days(spark, self.folder(service.name, service.version), now)
