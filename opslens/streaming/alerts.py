"""Alert state, instance memory and inbound deltas as keyed state of a stream.

All need the RocksDB state store provider (``spark.sql.streaming.stateStore.providerClass``).
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import asdict, fields

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import patterns as P
from ..functions.names import parse_order_index
from ..functions.times import HOUR, MINUTE
from ..operators.rules import SHORT_OF_TASKS, instance_lost
from ..operators.state import EVENT_SCHEMA, KEY, Tracker, _missing, complete

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "phase string, level string, since bigint, count bigint, climbs bigint, notified bigint, remind boolean"
_EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]



class AlertState(StatefulProcessor):
    """One ``Tracker`` per (rule, subject); the findings of a batch are taken in time order."""

    def __init__(self, repeat: Mapping[str, int]):
        self.repeat = dict(repeat)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tracker = Tracker()
        if self.state.exists():
            tracker = Tracker(**dict(zip([f.name for f in fields(Tracker)], self.state.get())))
        # the findings of one subject in one micro-batch: one per check
        found = pd.concat(list(rows)).sort_values(["at_ms", "gone"], ascending=[True, False])
        out = []
        for f in found.itertuples(index=False):
            event = tracker.see(f, self.repeat)
            if event:
                out.append((f.rule_id, f.subject, f.at_ms, *event, None if _missing(f.value) else f.value,
                            None if f.muted_by is None else list(f.muted_by), f.cluster))
        if tracker.phase == "ok":
            self.state.clear()
        else:
            self.state.update(tuple(_plain(v) for v in asdict(tracker).values()))
        yield pd.DataFrame(out, columns=_EVENT_COLUMNS)

    def close(self) -> None:
        pass


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def alert_stream(findings: DataFrame, rules: DataFrame | None = None,
                 repeat: Mapping[str, int] | None = None) -> DataFrame:
    """Events of a stream of findings. A subject a check no longer reports comes as a ``gone`` row."""
    rows = complete(findings, rules)
    return rows.groupBy(*KEY).transformWithStateInPandas(
        AlertState(P.REPEAT_MINUTES if repeat is None else repeat), EVENT_SCHEMA, "Append", "None")


_INSTANCE_ROW = "cluster string, instance_id string, at_ms bigint, bad boolean"
FORGET_MS = 24 * HOUR


class InstanceMemory(StatefulProcessor):
    """The instances a cluster had at its last check and those gone since, with the time of their first absence.

    Rows wait until the watermark has passed their check, whose timer then takes all due checks in time order: micro-batches may bring checks in
    any order. An instance is forgotten when it is back, at the first check that doesn't need it, or FORGET_MS after it was missed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms bigint, instance_id string, lost boolean, short boolean")
        self.memory = handle.getMapState("memory", "instance_id string", "gone_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            self.waiting.appendList([(int(r.at_ms), r.instance_id, None if _missing(r.lost) else bool(r.lost), None if _missing(r.short) else bool(r.short))
                                     for r in batch.itertuples(index=False)])
            times.update(int(t) for t in batch["at_ms"])
        for t in times:
            self.handle.registerTimer(t + 1)
        yield pd.DataFrame([], columns=[c.split()[0] for c in _INSTANCE_ROW.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        kept = [tuple(r) for r in self.waiting.get()]
        due = sorted({r[0] for r in kept if r[0] < upto})
        gone = {k[0]: v[0] for k, v in self.memory.iterator()}  # None: there at the last check
        before, out = set(gone), []
        for t in due:
            now = [r for r in kept if r[0] == t]
            here = {r[1]: r[2] for r in now if r[1] is not None}
            alarming = any(r[3] for r in now) or not here
            out += [(key[0], i, t, lost) for i, lost in here.items()]
            for i in [i for i in gone if i not in here]:
                gone[i] = t if gone[i] is None else gone[i]
                bad = alarming and t - gone[i] < FORGET_MS
                out.append((key[0], i, t, bad))
                if not bad:
                    del gone[i]
            gone.update(dict.fromkeys(here))
        if due:
            self.waiting.put([r for r in kept if r[0] >= upto])
        for i in before - set(gone):
            self.memory.removeKey((i,))
        for i, at in gone.items():
            self.memory.updateValue((i,), (at,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _INSTANCE_ROW.split(", ")])

    def close(self) -> None:
        pass


def instance_stream(history: DataFrame, services: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """cluster, instance_id, at_ms, bad as ``rules.ecs_instances`` finds them, from streams of instance snapshots and of the services of the same checks.

    A check is judged once the watermark, ``delay`` behind the newest check, has passed it.
    """
    none = F.lit(None)
    seen = history.select("cluster", "at_ms", "instance_id", instance_lost().alias("lost"), none.cast("boolean").alias("short"))
    state = services.select("cluster", "at_ms", none.cast("string").alias("instance_id"), none.cast("boolean").alias("lost"), F.coalesce(F.expr(SHORT_OF_TASKS), F.lit(False)).alias("short"))
    rows = seen.unionByName(state).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    return rows.groupBy("cluster").transformWithStateInPandas(InstanceMemory(), _INSTANCE_ROW, "Append", "EventTime")


class IndexCounts(StatefulProcessor):
    """Last run and document count of an index; emits its new documents at every later run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at_ms bigint, count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("snapshot_ms").itertuples(index=False):
            if not _missing(r.previous_ms):
                if last[0] == r.previous_ms:
                    fresh = max(0, r.docs_count - last[1])
                else:
                    made_since = not _missing(r.creation_ms) and r.creation_ms >= r.previous_ms - MINUTE
                    fresh = r.docs_count if made_since else 0
                out.append((int(r.previous_ms) // (5 * MINUTE) * 5 * MINUTE, r.tenant, int(fresh), int(r.docs_count),
                            int(r.snapshot_ms)))
            last = (int(r.snapshot_ms), int(r.docs_count))
        self.state.update(last)
        yield pd.DataFrame(out, columns=["t", "tenant", "orders", "docs", "at"])

    def close(self) -> None:
        pass


def inbound_stream(snapshots: DataFrame) -> DataFrame:
    """New documents per index and run, from snapshots that carry ``previous_ms``, the run before theirs.

    Sum by (t, tenant) in the sink, where every run also gets its ``_all`` row.
    """
    parts = parse_order_index(F.col("index"))
    rows = (snapshots.withColumn("p", parts)
            .filter("p IS NOT NULL AND p.variant IS NULL AND status <> 'close' AND docs_count IS NOT NULL")
            .select("index", "p.tenant", "snapshot_ms", "previous_ms", "docs_count", "creation_ms"))
    return rows.groupBy("index").transformWithStateInPandas(
        IndexCounts(), "t bigint, tenant string, orders bigint, docs bigint, at bigint", "Append", "None")
