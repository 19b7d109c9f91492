"""The operations summary of a day in progress and the report of a finished one, composed of the other operators."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.figures import change_pct
from ..functions.times import MINUTE, ZoneDay, floor_to
from . import inbound, metrics, orders, state


def ops_summary(calls: DataFrame, by_day: DataFrame, windows: DataFrame, day: ZoneDay, before: ZoneDay, as_of: int,
                thresholds: Mapping[str, float] | None = None, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The day so far against the same part of the day a week earlier.

    ``calls`` are API minutes, ``by_day`` first sightings per UTC day, ``windows`` inbound windows. Everything is cut off at the
    minute ``as_of``: the week before counts up to the same time of its day, a bucket in progress is NULL.
    """
    upto = as_of + MINUTE
    weeks = metrics.stage_weeks(calls, (day.start, upto), (before.start, upto - (day.start - before.start)))
    stages = weeks.select("*", *metrics.judge(thresholds)).withColumn("change", change_pct(F.col("calls"), F.col("lw_calls")))
    return {"stages": stages, "sparklines": metrics.sparkline(calls, day, as_of),
            "peak": metrics.peak_minute(calls, day.start, upto),
            "orders": orders.week_over_week(by_day, day, before, as_of, ("service",)),
            "inbound": inbound.inbound_day(windows, day, before, upto, exclude)}


def order_history(by_day: DataFrame, day: ZoneDay, before: ZoneDay, service: str | None = None, store: str | None = None,
                  as_of: int | None = None) -> DataFrame:
    """Orders per minute of a day, of a service or store if named, next to the same minutes a week earlier; NULL after ``as_of``."""
    wanted = by_day
    for column, value in (("service", service), ("store", store)):
        wanted = wanted if value is None else wanted.filter(F.col(column) == value)

    def minutes(d: ZoneDay, known_until: int | None) -> DataFrame:
        firsts = orders.zone_first_seen(wanted, d)
        counted = firsts.groupBy(floor_to("first_ms", MINUTE, d.start).alias("t")).agg(F.count("*").alias("orders"))
        return metrics.dense(counted, d.start, MINUTE, d.minutes, ["orders"], known_until)
    week = minutes(before, None).select((F.col("t") + (day.start - before.start)).alias("t"), F.col("orders").alias("lw_orders"))
    return minutes(day, None if as_of is None else as_of + MINUTE).join(week, "t", "full_outer")


def daily_report(calls: DataFrame, firsts: DataFrame, events: DataFrame, day: ZoneDay, before: ZoneDay,
                 thresholds: Mapping[str, float] | None = None, stores: int = 8, problems: int = 8, rules: int = 4) -> dict[str, DataFrame]:
    """The tables of ``metrics.daily_report`` and the alerts of the day: how many, and the rules that started most."""
    return {**metrics.daily_report(calls, firsts, day, before, thresholds, stores, problems),
            "recap": state.recap(events, day.start, day.end), "recap_rules": state.recap_rules(events, day.start, day.end, rules)}
