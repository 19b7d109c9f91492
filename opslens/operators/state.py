"""Alert state per (rule, subject): pending, firing at a level, muted, and the events on the way.

The batch form cuts every history where a finding clears it whatever came before, and streams the pieces through sorted
partitions, so that one subject's history is the work of many tasks; ``streaming.alerts`` feeds the same ``Tracker`` from a stream.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions.times import MINUTE

KEY = ["rule_id", "subject"]
EVENT_SCHEMA = ("rule_id string, subject string, at_ms bigint, event string, level string, value double, "
                "muted_by array<string>, cluster string")
RANK = {"warning": 1, "critical": 2}
IN_COLUMNS = ["rule_id", "subject", "at_ms", "bad", "value", "level", "warning", "critical", "h", "hold", "cluster",
              "muted_by", "muted_level", "confirm", "for_minutes", "base_level", "gone", "remind"]


def _missing(v: Any) -> bool:
    return v is None or (isinstance(v, float) and v != v)


@dataclass
class Tracker:
    """State of one subject. ``phase`` is ok, pending, firing, holding (pending while muted) or muted."""
    phase: str = "ok"
    level: str | None = None
    since: int = 0
    count: int = 0
    climbs: int = 0
    notified: int = 0
    remind: bool = False

    def level_for(self, f: Any) -> str | None:
        """The finding's level; a firing alert keeps its level until the value is h below that level's line."""
        if _missing(f.warning):
            return (f.level if not _missing(f.level) else f.base_level) if f.bad else None
        if _missing(f.value):
            return None
        held = RANK.get(self.level, 0) if self.phase == "firing" else 0
        for name, line in (("critical", f.critical), ("warning", f.warning)):
            if f.value >= line or (held >= RANK[name] and f.value > line - f.h):
                return name
        return None

    def ripe(self, f: Any) -> bool:
        """Seen often enough in a row, and for long enough."""
        return self.count >= f.confirm and f.at_ms - self.since >= max(f.for_minutes, f.hold) * MINUTE

    def reset(self) -> None:
        self.__dict__.update(asdict(Tracker()))

    def see(self, f: Any, repeat: Mapping[str, int]) -> tuple[str, str] | None:
        """Take one finding in time order; the event it causes, if any, with its level."""
        if f.remind and self.phase == "firing":
            self.remind = True
        if f.gone:
            event = ("resolved", self.level) if self.phase == "firing" else None
            self.reset()
            return event
        if f.muted_by is not None and len(f.muted_by):
            return self._muted(f)
        if self.phase in ("holding", "muted"):
            self.reset()
        level = self.level_for(f)
        if level is None:
            event = ("resolved", self.level) if self.phase == "firing" else None
            self.reset()
            return event
        if self.phase == "ok":
            self.phase, self.since = "pending", f.at_ms
        self.count += 1
        if self.phase == "pending":
            self.level = level
            if not self.ripe(f):
                return None
            self.phase, self.notified, self.climbs = "firing", f.at_ms, 0
            return ("firing", level)
        return self._firing(f, level, repeat)

    def _firing(self, f: Any, level: str, repeat: Mapping[str, int]) -> tuple[str, str] | None:
        step = RANK[level] - RANK[self.level]
        self.climbs = self.climbs + 1 if step > 0 else 0
        if step < 0 or (step > 0 and self.climbs >= f.confirm):
            self.level, self.notified, self.climbs = level, f.at_ms, 0
            return ("lowered" if step < 0 else "escalated", level)
        due = repeat.get(self.level, 0)
        if self.remind or (due and f.at_ms - self.notified >= due * MINUTE - 5000):
            self.remind, self.notified = False, f.at_ms
            return ("repeat", self.level)
        return None

    def _muted(self, f: Any) -> tuple[str, str] | None:
        wanted = self.level if self.phase == "firing" else f.muted_level
        level = wanted if wanted in RANK else f.base_level
        if self.phase == "firing":
            self.reset()
            self.phase, self.since, self.count = "muted", f.at_ms, f.confirm
            return ("muted", level)
        if self.phase == "ok":
            self.since, self.count = f.at_ms, 0
        if self.phase in ("ok", "pending"):
            self.phase = "holding"
        self.count += 1
        if self.phase == "holding" and self.ripe(f):
            self.phase = "muted"
            return ("muted", level)
        return None


def complete(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings with the settings the state needs: confirm, for_minutes, base_level per rule, gone and remind."""
    rows = findings
    if rules is not None:
        rows = rows.join(rules.select("rule_id", "confirm", "for_minutes", "base_level"), "rule_id", "left")
    defaults = {"confirm": F.lit(1), "for_minutes": F.lit(0), "base_level": F.lit("warning"), "gone": F.lit(False),
                "remind": F.lit(False), "muted_by": F.expr("CAST(NULL AS ARRAY<STRING>)"),
                **{c: F.lit(None).cast("double") for c in ("value", "warning", "critical", "h")},
                **{c: F.lit(None).cast("string") for c in ("level", "cluster", "muted_level")}, "hold": F.lit(0)}
    present = {c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()}
    return rows.withColumns(present).select(*IN_COLUMNS)


def with_gone(findings: DataFrame) -> DataFrame:
    """Adds a ``gone`` row at the first check of a rule that no longer reports a subject.

    Check times are few (one per rule and run); subjects are ordered among their own findings.
    """
    checks = findings.select("rule_id", "at_ms").distinct()
    checks = checks.withColumn("next_check", F.lead("at_ms").over(W.partitionBy("rule_id").orderBy("at_ms")))
    own = W.partitionBy(*KEY).orderBy("at_ms")
    last = (findings.withColumn("next_seen", F.lead("at_ms").over(own)).join(checks, ["rule_id", "at_ms"])
            .filter("next_check IS NOT NULL AND (next_seen IS NULL OR next_seen > next_check)"))
    gone = last.withColumns({"at_ms": F.col("next_check"), "gone": F.lit(True), "bad": F.lit(False),
                             "remind": F.lit(False)})
    return findings.unionByName(gone.select(*findings.columns))


def clears() -> Column:
    """Whether a finding leaves its subject in the state ok whatever the state before: gone, or neither muted nor at a level, even a held one."""
    muted = F.coalesce(F.size("muted_by") > 0, F.lit(False))
    held = [F.col("value") >= F.col(c) for c in ("warning", "critical")] + [F.col("value") > F.col(c) - F.col("h") for c in ("warning", "critical")]
    by_lines = F.greatest(*[F.coalesce(x, F.lit(False)) for x in held])
    level = F.when(F.col("warning").isNull() | F.isnan("warning"), F.coalesce("bad", F.lit(False))).otherwise(
        F.col("value").isNotNull() & ~F.isnan("value") & by_lines)
    return F.coalesce("gone", F.lit(False)) | (~muted & ~level)


def episodes(rows: DataFrame) -> DataFrame:
    """``rows`` (see ``complete``) with ``episode``: a new one begins after each finding that clears, so that episodes don't depend on one another.

    A clearing finding belongs to the episode it ends; one that ends none says nothing and is left out.
    """
    own = W.partitionBy(*KEY).orderBy("at_ms", F.desc("gone"))
    marked = rows.withColumn("_clears", clears())
    marked = marked.withColumns({"_after": F.lag("_clears", 1, True).over(own),
                                 "episode": F.coalesce(F.sum(F.col("_clears").cast("long")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    return marked.filter("NOT (_clears AND _after)").drop("_clears", "_after")


def _run(repeat: Mapping[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tracker = None, Tracker()
        for batch in batches:
            out = []
            for f in batch.itertuples(index=False):
                if (f.rule_id, f.subject, f.episode) != key:
                    key, tracker = (f.rule_id, f.subject, f.episode), Tracker()
                event = tracker.see(f, repeat)
                if event:
                    ids = None if f.muted_by is None else list(f.muted_by)
                    out.append((f.rule_id, f.subject, f.at_ms, *event, None if _missing(f.value) else f.value, ids, f.cluster))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT_SCHEMA.split(", ")])
    return run


def transitions(findings: DataFrame, rules: DataFrame | None = None,
                repeat: Mapping[str, int] | None = None) -> DataFrame:
    """Events of a history of findings: firing, escalated, lowered, repeat, resolved, muted.

    Only the window that numbers the episodes sees a subject's rows together; what a state machine has to walk through is one episode.
    """
    rows = episodes(with_gone(complete(findings, rules)))
    return (rows.repartition(*KEY, "episode").sortWithinPartitions(*KEY, "episode", "at_ms", F.desc("gone"))
            .mapInPandas(_run(dict(P.REPEAT_MINUTES if repeat is None else repeat)), EVENT_SCHEMA))


# ---- snoozes, board, recaps
def remind_after_snooze(findings: DataFrame, snoozes: DataFrame) -> DataFrame:
    """Marks the first finding at or after the end of a snooze, so that a still firing alert is told again."""
    ended = snoozes.filter("until IS NOT NULL").select(*KEY, "until")
    previous = F.lag("at_ms").over(W.partitionBy(*KEY).orderBy("at_ms"))
    rows = findings.withColumn("_previous", previous).join(ended, KEY, "left")
    crossed = (F.col("until") <= F.col("at_ms")) & (F.col("_previous").isNull() | (F.col("until") > F.col("_previous")))
    return rows.withColumn("remind", F.coalesce(crossed, F.lit(False))).drop("_previous", "until")


def apply_snoozes(events: DataFrame, snoozes: DataFrame) -> DataFrame:
    """Events with ``snoozed``: repeats of a snoozed alert are dropped, one snoozed until it clears says so.

    A snooze has an ``until`` time, or NULL for "until it clears".
    """
    own = snoozes.select(*KEY, F.col("until"), F.lit(True).alias("_has"))
    active = F.coalesce(F.col("_has") & (F.col("until").isNull() | (F.col("until") > F.col("at_ms"))), F.lit(False))
    clears = (F.col("event") == "resolved") & F.col("until").isNull()
    return (events.join(own, KEY, "left").withColumn("snoozed", active & ~clears)
            .filter(~(F.col("snoozed") & (F.col("event") == "repeat"))).drop("until", "_has"))


def board(events: DataFrame, snoozes: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """Subjects that are firing or muted now, worst level first, with a snooze that is still valid."""
    last = F.max_by(F.struct("event", "level", "value", "at_ms", "cluster"), "at_ms")
    rows = (events.groupBy(*KEY).agg(last.alias("e"), F.max(F.when(F.col("event") == "firing", F.col("at_ms")))
                                     .alias("fired_ms")).select(*KEY, "e.*", "fired_ms"))
    state = F.when(F.col("event") == "muted", "muted").when(F.col("event") != "resolved", "firing")
    rows = rows.withColumn("state", state).filter("state IS NOT NULL").drop("event")
    if snoozes is not None:
        valid = snoozes.filter(F.col("until").isNull() | (F.col("until") > now))
        rows = rows.join(valid.select(*KEY, "until", F.lit(True).alias("snoozed")), KEY, "left").na.fill(False, ["snoozed"])
    return rows.orderBy("state", F.desc(F.expr("CASE level WHEN 'critical' THEN 2 ELSE 1 END")), *KEY)


def mute_hits(events: DataFrame, now: int) -> DataFrame:
    """How often each mute entry stopped an alert in the last 24 hours and 7 days."""
    day, week = now - 24 * 60 * MINUTE, now - 7 * 24 * 60 * MINUTE
    hits = (events.filter((F.col("event") == "muted") & (F.col("at_ms") >= week))
            .select("at_ms", F.explode("muted_by").alias("mute_id")))
    return hits.groupBy("mute_id").agg(F.count(F.when(F.col("at_ms") >= day, 1)).alias("muted_24h"),
                                       F.count("*").alias("muted_7d"))


def digest(events: DataFrame, now: int, subjects: int = 3) -> DataFrame:
    """The last 7 days per rule: started, reached critical (escalations included), most frequent subjects."""
    week = events.filter((F.col("at_ms") >= now - 7 * 24 * 60 * MINUTE) & F.col("event").isin("firing", "escalated"))
    firing = F.col("event") == "firing"
    critical = ~firing | (F.coalesce("level", F.lit("critical")) == "critical")
    per_subject = week.groupBy(*KEY).agg(F.count(F.when(firing, 1)).alias("started"),
                                         F.count(F.when(critical, 1)).alias("critical"))
    best = W.partitionBy("rule_id").orderBy(F.desc("started"), "subject")
    top = (per_subject.filter("started > 0").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= subjects)
           .groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("r", "subject", "started"))).alias("top")))
    return (per_subject.groupBy("rule_id").agg(F.sum("started").alias("started"), F.sum("critical").alias("critical"))
            .join(top, "rule_id", "left").orderBy(F.desc("critical"), F.desc("started"), "rule_id"))


def recap(events: DataFrame, start: int, end: int) -> DataFrame:
    """Alerts of a day: how many started, and how many (rule, subject) reached critical in it."""
    day = events.filter((F.col("at_ms") >= start) & (F.col("at_ms") < end) & F.col("event").isin("firing", "escalated"))
    critical = (F.col("event") == "escalated") | (F.coalesce("level", F.lit("critical")) == "critical")
    return day.agg(F.count(F.when(F.col("event") == "firing", 1)).alias("started"),
                   F.count_distinct(F.when(critical, F.struct(*KEY))).alias("critical"))


def recap_rules(events: DataFrame, start: int, end: int, limit: int = 4) -> DataFrame:
    """The rules that started most alerts in a day."""
    day = events.filter((F.col("at_ms") >= start) & (F.col("at_ms") < end) & (F.col("event") == "firing"))
    return (day.groupBy("rule_id").agg(F.count("*").alias("started"))
            .orderBy(F.desc("started"), "rule_id").limit(limit))
