"""API metric minutes: windows, week over week, health board, range reports and series.

Metric rows are (t, api, stage, calls, err_4xx, err_5xx, p50, p95, ip95), one per minute and stage.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions.figures import change_pct, pct
from ..functions.times import (MINUTE, WEEK, Buckets, ZoneDay, calendar, floor_to, range_step, within,
                               zone_buckets)

STAGE = ["api", "stage"]
COUNTS = ["calls", "err_4xx", "err_5xx"]
LATENCIES = ["p50", "p95", "ip95"]


def _sums(test: str = "true", suffix: str = "") -> list[Column]:
    """Counts and call-weighted latency averages over the rows that pass a test."""
    counts = [F.expr(f"coalesce(sum({c}) FILTER (WHERE {test}), 0) AS {c}{suffix}") for c in COUNTS]
    latencies = [F.expr(f"round(sum({v} * calls) FILTER (WHERE {test}) / nullif(sum(calls) FILTER (WHERE {test} AND {v} "
                        f"IS NOT NULL), 0), 1) AS {v}{suffix}") for v in LATENCIES]
    return counts + latencies


def _window(start: int, end: int) -> str:
    return f"t >= {start} AND t < {end}"


def stage_window(metrics: DataFrame, start: int, end: int) -> DataFrame:
    """Per stage in [start, end): counts and call-weighted p50, p95 and backend p95."""
    return metrics.filter(within("t", start, end)).groupBy(*STAGE).agg(*_sums())


def stage_weeks(metrics: DataFrame, now: tuple[int, int], before: tuple[int, int]) -> DataFrame:
    """Two windows per stage side by side (``lw_`` columns: the earlier one), from one scan.

    A stage seen in only one window has a count of 0 in the other; ``seen`` and ``lw_seen`` tell.
    """
    a, b = _window(*now), _window(*before)
    earlier = [f"{c}__" for c in COUNTS + LATENCIES]
    rows = metrics.filter(F.expr(f"({a}) OR ({b})")).groupBy(*STAGE).agg(
        *_sums(a), *_sums(b, "__"), F.expr(f"count_if({a}) > 0 AS seen"), F.expr(f"count_if({b}) > 0 AS lw_seen"))
    return rows.withColumnsRenamed({c: "lw_" + c.removesuffix("__") for c in earlier})


def week_over_week(metrics: DataFrame, day: ZoneDay, before: ZoneDay, as_of: int) -> DataFrame:
    """Calls per stage up to ``as_of`` against the same part of the day a week earlier."""
    upto = as_of + MINUTE
    rows = stage_weeks(metrics, (day.start, upto), (before.start, upto - (day.start - before.start)))
    return rows.withColumn("change", change_pct(F.col("calls"), F.col("lw_calls")))


# ---- judging a stage
def judge(th: Mapping[str, float] | None = None) -> list[Column]:
    """[status, reasons] of ``stage_weeks`` rows: idle, red, amber or green; red reasons come first."""
    th = {**P.JUDGE_THRESHOLDS, **(th or {})}
    e5, e4, lw_e4, x = ("100D * err_5xx / calls", "100D * err_4xx / calls", "100D * lw_err_4xx / lw_calls",
                        "p95 / lw_p95")
    busy, lw_busy = f"calls >= {th['minCalls']}", f"lw_calls >= {th['minCalls']}"
    slow = (f"{busy} AND p95 > 0 AND lw_p95 > 0 AND {lw_busy} AND p95 >= {th['p95MinMs']}")
    share = "format_number(bround(100D * calls / lw_calls), '#')"
    one = lambda v: f"format_number({v}, '0.0')"
    slow_text = f"concat('p95 ', format_number(p95, '#,##0'), ' ms, ', {one(x)}, '× last week')"
    red5 = f"{busy} AND {e5} >= {th['err5xxRedPct']}"
    slow_red = f"{slow} AND {x} >= {th['p95RedTimes']}"
    reasons = [
        (red5, f"concat('5xx ', {one(e5)}, '%')"),
        (slow_red, slow_text),
        (f"{lw_busy} AND calls < lw_calls * {th['quietPct']} / 100", f"concat('calls ', {share}, '% of last week')"),
        (f"{busy} AND NOT ({red5}) AND {e5} >= {th['err5xxAmberPct']}", f"concat('5xx ', {one(e5)}, '%')"),
        (f"{busy} AND lw_calls > 0 AND {e4} >= {th['err4xxMinPct']} AND {e4} >= {th['err4xxTimesLastWeek']} * "
         f"greatest({lw_e4}, 0.1D)", f"concat('4xx ', {one(e4)}, '% (last week ', {one(lw_e4)}, '%)')"),
        (f"{slow} AND NOT ({slow_red}) AND {x} >= {th['p95AmberTimes']}", slow_text),
    ]
    found = "array_compact(array(" + ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in reasons) + "))"
    idle = f"calls < {th['minCalls']} AND lw_calls < {th['minCalls']}"
    status = (f"CASE WHEN {idle} THEN 'idle' WHEN calls = 0 THEN 'red' WHEN ({red5}) OR coalesce({slow_red}, false) "
              f"THEN 'red' WHEN size({found}) > 0 THEN 'amber' ELSE 'green' END")
    why = (f"CASE WHEN {idle} THEN array() WHEN calls = 0 THEN array(concat('no calls (last week ', "
           f"format_number(lw_calls, 0), ')')) ELSE {found} END")
    return [F.expr(f"{status} AS status"), F.expr(f"{why} AS reasons")]


def _shares(prefix: str = "") -> dict[str, Column]:
    calls = F.col(f"{prefix}calls")
    return {f"{prefix}err_4xx_pct": pct(F.col(f"{prefix}err_4xx"), calls),
            f"{prefix}err_5xx_pct": pct(F.col(f"{prefix}err_5xx"), calls)}


def health_board(metrics: DataFrame, upto: int, minutes: int = 60,
                 thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Every stage's last minutes against the same minutes a week (7 x 24 h) earlier, worst first."""
    if not 5 <= minutes <= 24 * 60:
        raise ValueError("minutes must be between 5 and 1440")
    start = upto - minutes * MINUTE
    rows = stage_weeks(metrics, (start, upto), (start - WEEK, upto - WEEK)).filter("calls > 0 OR lw_calls > 0")
    rank = F.expr("CASE status " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in P.BOARD_RANK.items()) + " END")
    return (rows.select("*", *judge(thresholds))
            .withColumns({**_shares(), "change": change_pct(F.col("calls"), F.col("lw_calls")),
                          "gateway_ms": F.round(F.col("p95") - F.col("ip95"), 1)})
            .orderBy(rank, F.desc("calls"), *STAGE))


def problem_stages(metrics: DataFrame, day: ZoneDay, before: ZoneDay,
                   thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Stages that looked wrong over a whole day, worst first: errors, then latency, and quiet or gone ones."""
    th = {**P.JUDGE_THRESHOLDS, "quietMinCalls": P.QUIET_MIN_CALLS, **(thresholds or {})}
    rows = stage_weeks(metrics, (day.start, day.end), (before.start, before.end))
    e5, x, busy = "100D * err_5xx / calls", "p95 / lw_p95", f"calls >= {th['minCalls']}"
    failing = f"{busy} AND err_5xx >= 10 AND {e5} >= {th['err5xxAmberPct']}"
    slow = (f"{busy} AND p95 > 0 AND lw_p95 > 0 AND p95 >= {th['p95MinMs']} AND lw_calls >= {th['minCalls']} AND "
            f"{x} >= {th['p95AmberTimes']}")
    quiet = f"lw_calls >= {th['quietMinCalls']} AND calls < lw_calls * {th['quietPct']} / 100"
    return rows.withColumn("problem", F.explode(F.expr(f"""array_compact(array(
        CASE WHEN {failing} THEN named_struct('kind', '5xx', 'rank', IF({e5} >= {th['err5xxRedPct']}, 2, 1),
                                              'value', round({e5}, 2))
             WHEN {slow} THEN named_struct('kind', 'p95', 'rank', IF({x} >= {th['p95RedTimes']}, 2, 1),
                                           'value', round({x}, 1)) END,
        CASE WHEN {quiet} THEN named_struct('kind', 'quiet', 'rank', 0, 'value', round(100D * calls / lw_calls, 0)) END
        ))"""))).select(*STAGE, "problem.*", "calls", "lw_calls").orderBy(F.desc("rank"), *STAGE)


# ---- series
def dense(series: DataFrame, first: int, step: int, count: int, values: Sequence[str],
          known_until: int | None = None) -> DataFrame:
    """One row per bucket: 0 where nothing was counted, NULL from ``known_until`` on (not counted yet)."""
    spark = series.sparkSession
    rows = calendar(spark, first, step, count).join(series, "t", "left")
    filled = {v: F.coalesce(v, F.lit(0)) for v in values}
    if known_until is not None:
        filled = {v: F.when(F.col("t") < known_until, c) for v, c in filled.items()}
    return rows.withColumns(filled)


def minute_series(metrics: DataFrame, day: ZoneDay, as_of: int | None = None, stage: str | None = None) -> DataFrame:
    """The day's minutes: counts and latency, 0 where none; NULL after the newest minute of a day in progress."""
    rows = metrics.filter(within("t", day.start, day.end))
    if stage:
        api, _, name = stage.rpartition("/")
        rows = rows.filter((F.col("api") == api) & (F.col("stage") == name))
    minutes = rows.groupBy("t").agg(*_sums())
    upto = None if as_of is None else as_of + MINUTE
    return dense(minutes, day.start, MINUTE, day.minutes, COUNTS, upto).select("t", *COUNTS, "p95", "ip95")


def day_history(metrics: DataFrame, day: ZoneDay, before: ZoneDay, stage: str | None = None,
                as_of: int | None = None) -> DataFrame:
    """Minutes of a day with the calls of the same minute of a day a week earlier."""
    week = minute_series(metrics, before, None, stage).select(
        (F.col("t") + (day.start - before.start)).alias("t"), F.col("calls").alias("lw_calls"),
        F.col("p95").alias("lw_p95"))
    return minute_series(metrics, day, as_of, stage).join(week, "t", "full_outer")


def sparkline(metrics: DataFrame, day: ZoneDay, as_of: int | None = None, minutes: int = 15) -> DataFrame:
    """(api, stage, t, calls) per quarter hour, zero-filled; the bucket in progress is NULL."""
    step = minutes * MINUTE
    counted = (metrics.filter(within("t", day.start, day.end))
               .groupBy(*STAGE, floor_to("t", step, day.start).alias("t")).agg(F.sum("calls").alias("calls")))
    grid = (counted.select(*STAGE).distinct()
            .withColumn("t", F.explode(F.expr(f"sequence({day.start}L, {day.end - 1}L, {step}L)"))))
    done = day.end if as_of is None else day.start + (as_of + MINUTE - day.start) // step * step
    return (grid.join(counted, [*STAGE, "t"], "left")
            .withColumn("calls", F.when(F.col("t") + step <= done, F.coalesce("calls", F.lit(0)))
                        if as_of is not None else F.coalesce("calls", F.lit(0))))


def stage_shares(metrics: DataFrame, start: int, end: int) -> DataFrame:
    """Calls per stage and their share of all calls; one row per stage goes into the total."""
    rows = stage_window(metrics, start, end)
    return rows.select(*STAGE, "calls", pct(F.col("calls"), F.sum("calls").over(W.partitionBy())).alias("share"))


def peak_minute(metrics: DataFrame, start: int, end: int) -> DataFrame:
    """The busiest minute and its calls; the earliest of equals."""
    minutes = metrics.filter(within("t", start, end)).groupBy("t").agg(F.sum("calls").alias("calls"))
    return minutes.agg(F.max_by("t", F.struct("calls", -F.col("t"))).alias("t"), F.max("calls").alias("calls"))


def cumulative(series: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running total over a day's minutes; NULL where the value is NULL. One row per minute and key."""
    upto = W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn("total", F.when(F.col(value).isNotNull(), F.sum(value).over(upto)))


def rebucket(series: DataFrame, value: str, first: int, step: int, mode: str = "sum") -> DataFrame:
    """Minutes grouped into larger buckets: a sum with a gap is NULL, an average skips gaps."""
    v = F.col(value)
    whole = F.when(F.count("*") == F.count(v), F.sum(v)) if mode == "sum" else F.avg(v)
    return series.groupBy(floor_to("t", step, first).alias("t")).agg(whole.alias(value))


def last_known(series: DataFrame, value: str, n: int, other: str | None = None) -> DataFrame:
    """Sum of the last n known minutes, and of the same minutes in another column."""
    end = series.filter(F.col(value).isNotNull()).agg(F.max("t")).scalar()
    rows = series.filter((F.col("t") <= end) & (F.col("t") > end - n * MINUTE))
    sums = [F.coalesce(F.sum(value), F.lit(0)).alias("sum")]
    sums += [F.coalesce(F.sum(other), F.lit(0)).alias("other")] if other else []
    return rows.agg(*sums, F.count("*").alias("minutes"))


def freshness(metrics: DataFrame, now: int, stale_ms: int = 15 * MINUTE) -> DataFrame:
    """Newest minute, its age and whether that is too old."""
    newest = metrics.agg(F.max("t").alias("as_of"))
    return (newest.withColumn("age_ms", F.greatest(F.lit(0), F.lit(now) - (F.col("as_of") + MINUTE)))
            .withColumn("stale", F.coalesce(F.col("age_ms") > stale_ms, F.lit(True))))


# ---- range reports
def range_buckets(start: int, end: int, zone: str) -> Buckets:
    """Buckets for a range chart, on round times in the zone."""
    return zone_buckets(start, end, zone, range_step(end - start))


def range_stages(metrics: DataFrame, start: int, end: int) -> DataFrame:
    """The table of a range report: counts, shares, latencies and the time spent outside the backend."""
    rows = stage_window(metrics, start, end)
    return rows.withColumns({
        "share": pct(F.col("calls"), F.sum("calls").over(W.partitionBy())), **_shares(),
        "gateway_ms": F.round(F.col("p95") - F.col("ip95"), 1)})


def range_series(metrics: DataFrame, start: int, end: int, zone: str, stage: str | None = None) -> DataFrame:
    """The chart of a range report.

    Sums of buckets the range or the data only partly covers are NULL; averages of any known bucket
    are kept. ``as_of`` is the newest minute of all stages in the range.
    """
    b = range_buckets(start, end, zone)
    rows = metrics.filter(within("t", start, end))
    newest = rows.agg(F.max("t")).scalar()
    wanted = rows
    if stage:
        api, _, name = stage.rpartition("/")
        wanted = rows.filter((F.col("api") == api) & (F.col("stage") == name))
    counted = (wanted.withColumn("t", floor_to("t", b.step, b.first)).groupBy("t").agg(*_sums()))
    series = dense(counted, b.first, b.step, b.count, COUNTS).withColumn("as_of", newest)
    t, upto = F.col("t"), F.least(F.lit(end), F.col("as_of") + MINUTE)
    begun = t <= F.col("as_of")
    whole = begun if b.step == MINUTE else begun & (t >= start) & (t + b.step <= upto)
    return series.select("t", *[F.when(whole, F.col(c)).alias(c) for c in COUNTS],
                         *[F.when(begun, F.col(c)).alias(c) for c in ("p95", "ip95")])


# ---- loading
def metric_pivot(points: DataFrame) -> DataFrame:
    """Long points (minute, api, stage, metric, statistic, value) -> one row per minute and stage.

    Sums become whole numbers, percentiles keep one decimal.
    """
    # Column, metric, statistic.
    layout = [("calls", "Count", "Sum"), ("err_4xx", "4XXError", "Sum"), ("err_5xx", "5XXError", "Sum"),
              ("latency_p50_ms", "Latency", "p50"), ("latency_p95_ms", "Latency", "p95"),
              ("integration_p95_ms", "IntegrationLatency", "p95")]
    picks = [F.expr(f"max(value) FILTER (WHERE metric = '{metric}' AND statistic = '{stat}')").alias(name)
             for name, metric, stat in layout]
    wide = points.groupBy("minute", *STAGE).agg(*picks)
    return wide.select("minute", *STAGE, *[(F.bround(name).cast("bigint") if stat == "Sum" else F.round(name, 1))
                                           .alias(name) for name, _, stat in layout])


def daily_report(metrics: DataFrame, orders: DataFrame, day: ZoneDay, before: ZoneDay,
                 thresholds: Mapping[str, float] | None = None, stores: int = 8,
                 problems: int = 8) -> dict[str, DataFrame]:
    """Tables of the daily report, all against the whole day a week earlier.

    ``orders`` are first sightings (service, store, order_id, first_ms).
    """
    a, b = _window(day.start, day.end), _window(before.start, before.end)
    kpi = metrics.filter(F.expr(f"({a}) OR ({b})")).agg(
        *_sums(a)[:3], F.expr(f"coalesce(sum(calls) FILTER (WHERE {b}), 0) AS lw_calls"))
    kpi = kpi.withColumns({**_shares(), "change": change_pct(F.col("calls"), F.col("lw_calls"))})

    def counted(*keys: str) -> DataFrame:
        inside = [within("first_ms", d.start, d.end) for d in (day, before)]
        rows = orders.filter(inside[0] | inside[1]).groupBy(*keys).agg(
            F.count(F.when(inside[0], 1)).alias("orders"), F.count(F.when(inside[1], 1)).alias("lw_orders"))
        return rows.withColumn("change", change_pct(F.col("orders"), F.col("lw_orders")))
    return {"kpi": kpi, "peak": peak_minute(metrics, day.start, day.end),
            "services": counted("service").orderBy(F.desc("orders"), "service"),
            "stores": counted("service", "store").filter("orders > 0")
            .orderBy(F.desc("orders"), "store", "service").limit(stores),
            "problems": problem_stages(metrics, day, before, thresholds).limit(problems)}


