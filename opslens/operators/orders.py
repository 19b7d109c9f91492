"""Orders counted once, at their first sighting in a service's log lines."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.figures import change_pct
from ..functions.names import lookup, store_name
from ..functions.times import HOUR, MINUTE, ZoneDay, floor_to, within

KEY = ["service", "store", "order_id"]


@dataclass(frozen=True)
class OrderLine:
    """A log line that announces an order: a text it contains and a regex whose groups are named.

    ``groups`` maps order, store, tenant (and any group ``skip`` looks at) to group numbers;
    ``skip`` lists group values that make the line no order.
    """
    contains: str
    regex: str
    groups: Mapping[str, int]
    skip: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def group(self, text: Column, name: str) -> Column:
        if name not in self.groups:
            return F.lit(None).cast("string")
        return F.regexp_extract(text, self.regex, self.groups[name])


def extract_orders(logs: DataFrame, service: str, lines: Sequence[OrderLine],
                   tenants: Mapping[str, str] | None = None) -> DataFrame:
    """(service, store, order_id, ms) of the lines that announce an order.

    The first pattern that fits a line decides; if it finds no order, or a skipped one, the line is
    done with. The text here is the first column that is not NULL, blank or not.
    """
    said = [F.col(c) for c in ("msg", "body", "raw") if c in logs.columns]
    text = F.col("_text")
    found = F.lit(None)
    for line in reversed(lines):
        order = F.trim(line.group(text, "order"))
        skipped = reduce(lambda a, b: a | b, [line.group(text, g).isin(list(v)) for g, v in line.skip.items()],
                         F.lit(False))
        tenant = F.trim(F.coalesce(line.group(text, "tenant"), F.lit("")))
        own = F.lower(F.trim(F.coalesce(line.group(text, "store"), F.lit(""))))
        store = F.when(own != "", own).otherwise(F.coalesce(lookup(tenant, tenants or {}), tenant))
        good = (F.coalesce(order, F.lit("")) != "") & (F.lower(order) != "null") & ~F.coalesce(skipped, F.lit(False))
        hit = F.struct(good.alias("good"), store.alias("store"), order.alias("order_id"))
        found = F.when(F.contains(text, F.lit(line.contains)) & text.rlike(line.regex), hit).otherwise(found)
    anywhere = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in sorted({x.contains for x in lines})])
    return (logs.select("log_time_ms", F.coalesce(*said).alias("_text"))
            .filter(F.col("log_time_ms").isNotNull() & anywhere).withColumn("hit", found)
            .filter("hit.good").select(F.lit(service).alias("service"), "hit.store", "hit.order_id",
                                       F.col("log_time_ms").alias("ms")))


def first_seen(sightings: DataFrame, ms: str = "ms") -> DataFrame:
    """First sighting of every (service, store, order). A minimum, so any number of parts can be merged again."""
    return sightings.groupBy(*KEY).agg(F.min(ms).alias("first_ms"))


def first_seen_by_utc_day(sightings: DataFrame) -> DataFrame:
    """First sighting of every order within each UTC day: the table kept per day."""
    day = F.to_date(F.timestamp_millis("ms"))
    return sightings.groupBy(day.alias("day"), *KEY).agg(F.min("ms").alias("first_ms"))


def zone_first_seen(by_day: DataFrame, day: ZoneDay) -> DataFrame:
    """First sightings of a zone's day from the UTC days it overlaps; earlier days are not looked at."""
    first, last = (F.date_from_unix_date(F.lit(d)) for d in day.utc_days)
    merged = by_day.filter(F.col("day").between(first, last)).groupBy(*KEY).agg(F.min("first_ms").alias("first_ms"))
    return merged.filter(within("first_ms", day.start, day.end))


def counts(firsts: DataFrame, keys: Sequence[str] = ("service",), step: int | None = None, first: int = 0) -> DataFrame:
    """Orders per service, store, minute, hour …: ``keys`` and an optional time bucket."""
    groups = [*keys] + ([floor_to("first_ms", step, first).alias("t")] if step else [])
    return firsts.groupBy(*groups).agg(F.count("*").alias("orders"))


def per_minute(firsts: DataFrame, start: int) -> DataFrame:
    return counts(firsts, (), MINUTE, start)


def per_hour(firsts: DataFrame, start: int, keys: Sequence[str] = ("service",)) -> DataFrame:
    return counts(firsts, keys, HOUR, start)


def week_over_week(by_day: DataFrame, day: ZoneDay, before: ZoneDay, as_of: int,
                   keys: Sequence[str] = ("service", "store")) -> DataFrame:
    """Orders per key up to ``as_of`` against the same part of the day a week earlier, and its whole day."""
    cutoff = as_of + MINUTE - (day.start - before.start)
    now = zone_first_seen(by_day, day).filter(F.col("first_ms") <= as_of).groupBy(*keys).agg(
        F.count("*").alias("orders"))
    week = zone_first_seen(by_day, before).groupBy(*keys).agg(
        F.count(F.when(F.col("first_ms") < cutoff, 1)).alias("lw_orders"), F.count("*").alias("lw_day_orders"))
    both = now.join(week, list(keys), "full_outer").na.fill(0, ["orders", "lw_orders", "lw_day_orders"])
    both = both.withColumn("change", change_pct(F.col("orders"), F.col("lw_orders")))
    return both.withColumn("name", store_name(F.col("store"))) if "store" in keys else both


def range_counts(by_day: DataFrame, start: int, end: int, first: int, step: int,
                 keys: Sequence[str] = ("service",)) -> DataFrame:
    """Orders first seen in [start, end) per bucket; the UTC days of the range are joined by first sighting."""
    day = F.col("day")
    days = by_day.filter((day >= F.to_date(F.timestamp_millis(F.lit(start)))) &
                         (day <= F.to_date(F.timestamp_millis(F.lit(end - 1)))))
    merged = days.groupBy(*KEY).agg(F.min("first_ms").alias("first_ms")).filter(within("first_ms", start, end))
    return counts(merged, keys, step, first)
