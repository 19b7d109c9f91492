"""API metrics, zone days, orders and inbound windows."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, MINUTE, WEEK, zone_buckets, zone_day, zone_midnight_ms
from ..operators import inbound, metrics, orders, reports
from . import views
from .oracle import sql
from .registry import Registry

QUERIES = Registry()

DATE = date(2024, 1, 16)
TODAY, LAST_WEEK = zone_day(DATE, "PST"), zone_day(DATE - timedelta(days=7), "PST")
AS_OF = TODAY.start + 17 * HOUR + 23 * MINUTE
START, END = TODAY.start + 90 * MINUTE, TODAY.start + 5 * DAY + 7 * MINUTE
THRESHOLDS = {"minCalls": 300, "err5xxAmberPct": 0.4, "err5xxRedPct": 0.7, "err4xxMinPct": 1.0, "p95MinMs": 500,
              "quietPct": 90, "quietMinCalls": 300}


def _sums(test: str = "true", suffix: str = "") -> str:
    counts = [f"CAST(coalesce(sum({c}) FILTER ({test}), 0) AS BIGINT) AS {c}{suffix}"
              for c in ("calls", "err_4xx", "err_5xx")]
    return ", ".join(counts + [
        f"CAST(printf('%.1f', sum({v} * calls) FILTER ({test}) / nullif(sum(calls) FILTER (({test}) AND {v} IS NOT NULL), 0)) AS DOUBLE) AS "
        f"{v}{suffix}" for v in ("p50", "p95", "ip95")])


def _weeks(now: tuple[int, int], before: tuple[int, int]) -> str:
    a, b = f"t >= {now[0]} AND t < {now[1]}", f"t >= {before[0]} AND t < {before[1]}"
    earlier = _sums(b, "__")
    for c in ("calls", "err_4xx", "err_5xx", "p50", "p95", "ip95"):
        earlier = earlier.replace(f"AS {c}__", f"AS lw_{c}")
    return (f"SELECT api, stage, {_sums(a)}, {earlier}, count(*) FILTER ({a}) > 0 AS seen, count(*) FILTER ({b}) > 0 "
            f"AS lw_seen FROM v_metric WHERE ({a}) OR ({b}) GROUP BY api, stage")


def _change(now: str, before: str) -> str:
    return f"round(100.0::DOUBLE * ({now} - {before}) / nullif({before}, 0), 1)"


def _pct(part: str, whole: str) -> str:
    return f"round(100.0::DOUBLE * {part} / nullif({whole}, 0), 2)"


# ---- zone days
@QUERIES.add("zone_days", """
    SELECT day, zone, CAST(epoch_ms(start) AS BIGINT) AS start_ms, CAST(epoch_ms(stop) - epoch_ms(start) AS BIGINT) // 60000 AS minutes
    FROM (SELECT day, zone, timezone(tz, CAST(day AS TIMESTAMP)) AS start,
                 timezone(tz, CAST(day + 1 AS TIMESTAMP)) AS stop
          FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
          CROSS JOIN (VALUES ('IST', 'Asia/Kolkata'), ('PST', 'America/Los_Angeles'), ('EST', 'America/New_York'),
                             ('UTC', 'UTC')) z(zone, tz))""")
def zone_days(spark, sf_dir):
    """Every order date as a civil day in each zone, with its length around clock changes."""
    days = views.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    parts = [days.select("day", F.lit(z).alias("zone"), zone_midnight_ms(F.col("day"), z).alias("start_ms"),
                         zone_midnight_ms(F.date_add("day", 1), z).alias("end_ms")) for z in ("IST", "PST", "EST", "UTC")]
    from functools import reduce
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.select("day", "zone", "start_ms",
                       ((F.col("end_ms") - F.col("start_ms")) / MINUTE).cast("bigint").alias("minutes"))


@QUERIES.add("zone_buckets", sql(f"""SELECT (t - b.first) // b.step * b.step + b.first AS bucket, CAST(sum(calls) AS BIGINT) AS calls
    FROM v_metric CROSS JOIN (SELECT {zone_buckets(START, END, 'IST', 3 * HOUR).first} AS first, {3 * HOUR} AS step) b
    WHERE t >= {START} AND t < {END} GROUP BY 1"""))
def zone_bucket_sums(spark, sf_dir):
    from ..functions.times import floor_to, within
    b = zone_buckets(START, END, "IST", 3 * HOUR)
    rows = views.metrics(spark, sf_dir).filter(within("t", START, END))
    return rows.groupBy(floor_to("t", b.step, b.first).alias("bucket")).agg(F.sum("calls").alias("calls"))


# ---- stages
@QUERIES.add("stage_window", sql(f"SELECT api, stage, {_sums()} FROM v_metric WHERE t >= {START} AND t < {END} "
                                 "GROUP BY api, stage"))
def stage_window(spark, sf_dir):
    return metrics.stage_window(views.metrics(spark, sf_dir), START, END)


_UPTO = AS_OF + MINUTE
_CUT = _UPTO - (TODAY.start - LAST_WEEK.start)


@QUERIES.add("stage_wow", sql(f"""SELECT api, stage, calls, lw_calls, p95, lw_p95, {_change('calls', 'lw_calls')} AS change
    FROM ({_weeks((TODAY.start, _UPTO), (LAST_WEEK.start, _CUT))})"""))
def stage_wow(spark, sf_dir):
    rows = metrics.week_over_week(views.metrics(spark, sf_dir), TODAY, LAST_WEEK, AS_OF)
    return rows.select("api", "stage", "calls", "lw_calls", "p95", "lw_p95", "change")


def _judge(weeks: str) -> str:
    th = THRESHOLDS
    e5, e4, l4, x = ("100.0::DOUBLE * err_5xx / calls", "100.0::DOUBLE * err_4xx / calls",
                     "100.0::DOUBLE * lw_err_4xx / lw_calls", "p95 / lw_p95")
    return f"""
      w AS ({weeks}), f AS (SELECT *, calls >= {th['minCalls']} AS busy, lw_calls >= {th['minCalls']} AS lw_busy,
        CASE WHEN calls > 0 THEN {e5} END AS e5, CASE WHEN calls > 0 THEN {e4} END AS e4,
        CASE WHEN lw_calls > 0 THEN {l4} END AS l4,
        CASE WHEN calls >= {th['minCalls']} AND lw_calls >= {th['minCalls']} AND p95 >= {th['p95MinMs']} AND lw_p95 > 0
             THEN {x} END AS x FROM w),
      r AS (SELECT *, busy AND e5 >= {th['err5xxRedPct']} AS red5, coalesce(x >= 2.0, false) AS redx,
        lw_busy AND calls < lw_calls * {th['quietPct']} / 100.0 AS quiet,
        busy AND e5 >= {th['err5xxAmberPct']} AND e5 < {th['err5xxRedPct']} AS amber5,
        busy AND l4 IS NOT NULL AND e4 >= {th['err4xxMinPct']} AND e4 >= 2.0 * greatest(l4, 0.1) AS amber4,
        coalesce(x >= 1.5 AND x < 2.0, false) AS amberx FROM f),
      j AS (SELECT *, CASE WHEN NOT busy AND NOT lw_busy THEN 'idle' WHEN calls = 0 OR red5 OR redx THEN 'red'
                           WHEN quiet OR amber5 OR amber4 OR amberx THEN 'amber' ELSE 'green' END AS status,
        CASE WHEN NOT busy AND NOT lw_busy THEN '' WHEN calls = 0 THEN 'no calls (last week ' || format('{{:,}}', lw_calls) || ')'
             ELSE concat_ws('; ', CASE WHEN red5 THEN '5xx ' || printf('%.1f', e5) || '%' END,
               CASE WHEN redx THEN 'p95 ' || format('{{:,}}', CAST(round_even(p95, 0) AS BIGINT)) || ' ms, ' || printf('%.1f', x) || '× last week' END,
               CASE WHEN quiet THEN 'calls ' || CAST(round_even(100.0::DOUBLE * calls / lw_calls, 0) AS INTEGER) || '% of last week' END,
               CASE WHEN amber5 THEN '5xx ' || printf('%.1f', e5) || '%' END,
               CASE WHEN amber4 THEN '4xx ' || printf('%.1f', e4) || '% (last week ' || printf('%.1f', l4) || '%)' END,
               CASE WHEN amberx THEN 'p95 ' || format('{{:,}}', CAST(round_even(p95, 0) AS BIGINT)) || ' ms, ' || printf('%.1f', x) || '× last week' END)
             END AS reasons FROM r)"""


@QUERIES.add("stage_judge", sql(f"WITH {_judge(_weeks((TODAY.start, TODAY.end), (LAST_WEEK.start, LAST_WEEK.end)))} "
                                "SELECT api, stage, calls, lw_calls, status, reasons FROM j"))
def stage_judge(spark, sf_dir):
    rows = metrics.stage_weeks(views.metrics(spark, sf_dir), (TODAY.start, TODAY.end), (LAST_WEEK.start, LAST_WEEK.end))
    judged = rows.select("*", *metrics.judge(THRESHOLDS))
    return judged.select("api", "stage", "calls", "lw_calls", "status", F.array_join("reasons", "; ").alias("reasons"))


@QUERIES.add("stage_health", sql(f"""WITH {_judge(_weeks((_UPTO - DAY, _UPTO), (_UPTO - DAY - WEEK, _UPTO - WEEK)))}
    SELECT api, stage, calls, lw_calls, status, reasons, {_change('calls', 'lw_calls')} AS change,
           {_pct('err_4xx', 'calls')} AS err_4xx_pct, {_pct('err_5xx', 'calls')} AS err_5xx_pct,
           round(p95 - ip95, 1) AS gateway_ms FROM j WHERE calls > 0 OR lw_calls > 0"""))
def stage_health(spark, sf_dir):
    rows = metrics.health_board(views.metrics(spark, sf_dir), _UPTO, 24 * 60, THRESHOLDS)
    return rows.select("api", "stage", "calls", "lw_calls", "status", F.array_join("reasons", "; ").alias("reasons"),
                       "change", "err_4xx_pct", "err_5xx_pct", "gateway_ms")


@QUERIES.add("problem_stages", sql(f"""WITH
    w AS ({_weeks((TODAY.start, TODAY.end), (LAST_WEEK.start, LAST_WEEK.end))}),
    e AS (SELECT *, 100.0::DOUBLE * err_5xx / nullif(calls, 0) AS e5, CASE WHEN p95 >= 500 AND lw_p95 > 0 THEN p95 / lw_p95 END AS x FROM w),
    k AS (SELECT *, CASE WHEN calls >= 300 AND err_5xx >= 10 AND e5 >= 0.4 THEN '5xx'
                         WHEN calls >= 300 AND lw_calls >= 300 AND x >= 1.5 THEN 'p95' END AS kind FROM e)
    SELECT api, stage, kind, CAST(CASE WHEN kind = '5xx' AND e5 >= 0.7 OR kind = 'p95' AND x >= 2 THEN 2 ELSE 1 END AS INTEGER) AS rank,
           CASE kind WHEN '5xx' THEN round(e5, 2) ELSE round(x, 1) END AS value, calls, lw_calls FROM k WHERE kind IS NOT NULL
    UNION ALL SELECT api, stage, 'quiet', 0, round(100.0::DOUBLE * calls / lw_calls, 0), calls, lw_calls FROM k
              WHERE lw_calls >= 300 AND calls < lw_calls * 90 / 100.0"""))
def problem_stages(spark, sf_dir):
    return metrics.problem_stages(views.metrics(spark, sf_dir), TODAY, LAST_WEEK, THRESHOLDS)


# ---- series
_MINUTES = f"c AS (SELECT unnest(range({TODAY.start}, {TODAY.end}, 60000)) AS t)"
_DAY = f"s AS (SELECT t, {_sums()} FROM v_metric WHERE t >= {TODAY.start} AND t < {TODAY.end} GROUP BY t)"
_KNOWN = ", ".join(f"CASE WHEN c.t < {_UPTO} THEN coalesce({c}, 0) END AS {c}" for c in ("calls", "err_4xx", "err_5xx"))


@QUERIES.add("day_series", sql(f"WITH {_MINUTES}, {_DAY} SELECT c.t, {_KNOWN}, p95, ip95 FROM c LEFT JOIN s USING (t)"))
def day_series(spark, sf_dir):
    return metrics.minute_series(views.metrics(spark, sf_dir), TODAY, AS_OF)


@QUERIES.add("day_history", sql(f"""WITH {_MINUTES},
    s AS (SELECT t, {_sums()} FROM v_metric WHERE t >= {TODAY.start} AND t < {TODAY.end} AND api = 'api1' AND stage = 'st3' GROUP BY t),
    l AS (SELECT t + {WEEK} AS t, {_sums()} FROM v_metric WHERE t >= {LAST_WEEK.start} AND t < {LAST_WEEK.end} AND api = 'api1'
          AND stage = 'st3' GROUP BY t)
    SELECT c.t, {', '.join(f'coalesce(s.{c}, 0) AS {c}' for c in ('calls', 'err_4xx', 'err_5xx'))}, s.p95, s.ip95,
           coalesce(l.calls, 0) AS lw_calls, l.p95 AS lw_p95 FROM c LEFT JOIN s USING (t) LEFT JOIN l USING (t)"""))
def day_history(spark, sf_dir):
    return metrics.day_history(views.metrics(spark, sf_dir), TODAY, LAST_WEEK, "api1/st3")


@QUERIES.add("sparkline", sql(f"""WITH g AS (SELECT DISTINCT api, stage FROM v_metric WHERE t >= {TODAY.start} AND t < {TODAY.end}),
    c AS (SELECT api, stage, unnest(range({TODAY.start}, {TODAY.end}, 900000)) AS t FROM g),
    s AS (SELECT api, stage, (t - {TODAY.start}) // 900000 * 900000 + {TODAY.start} AS t, CAST(sum(calls) AS BIGINT) AS calls
          FROM v_metric WHERE t >= {TODAY.start} AND t < {TODAY.end} GROUP BY 1, 2, 3)
    SELECT c.api, c.stage, c.t, CASE WHEN c.t + 900000 <= {TODAY.start + (_UPTO - TODAY.start) // 900000 * 900000}
           THEN coalesce(calls, 0) END AS calls FROM c LEFT JOIN s USING (api, stage, t)"""))
def sparkline(spark, sf_dir):
    return metrics.sparkline(views.metrics(spark, sf_dir), TODAY, AS_OF)


@QUERIES.add("cumulative", sql(f"""WITH {_MINUTES}, {_DAY}, d AS (SELECT c.t, CASE WHEN c.t < {_UPTO} THEN coalesce(calls, 0) END AS calls
    FROM c LEFT JOIN s USING (t))
    SELECT t, calls, CASE WHEN calls IS NOT NULL THEN CAST(sum(calls) OVER (ORDER BY t) AS BIGINT) END AS total FROM d"""))
def cumulative(spark, sf_dir):
    series = metrics.minute_series(views.metrics(spark, sf_dir), TODAY, AS_OF).select("t", "calls")
    return metrics.cumulative(series, "calls")


def _rebucket(agg: str) -> str:
    return sql(f"""WITH {_MINUTES}, {_DAY}, d AS (SELECT c.t, CASE WHEN c.t < {_UPTO} THEN coalesce(calls, 0) END AS calls, p95
        FROM c LEFT JOIN s USING (t))
        SELECT (t - {TODAY.start}) // 1800000 * 1800000 + {TODAY.start} AS t, {agg} FROM d GROUP BY 1""")


@QUERIES.add("rebucket_sum", _rebucket("CASE WHEN count(*) = count(calls) THEN CAST(sum(calls) AS BIGINT) END AS calls"))
def rebucket_sum(spark, sf_dir):
    return metrics.rebucket(metrics.minute_series(views.metrics(spark, sf_dir), TODAY, AS_OF), "calls", TODAY.start,
                            30 * MINUTE)


@QUERIES.add("rebucket_avg", _rebucket("round(avg(p95), 6) AS p95"))
def rebucket_avg(spark, sf_dir):
    rows = metrics.rebucket(metrics.minute_series(views.metrics(spark, sf_dir), TODAY, AS_OF), "p95", TODAY.start,
                            30 * MINUTE, "avg")
    return rows.withColumn("p95", F.round("p95", 6))


@QUERIES.add("last_known", sql(f"""WITH {_MINUTES}, {_DAY}, d AS (SELECT c.t, CASE WHEN c.t < {_UPTO} THEN coalesce(calls, 0) END AS calls
    FROM c LEFT JOIN s USING (t))
    SELECT CAST(sum(calls) AS BIGINT) AS sum, count(*) AS minutes FROM d WHERE t < {_UPTO} AND t >= {_UPTO - 60 * MINUTE}"""))
def last_known(spark, sf_dir):
    return metrics.last_known(metrics.minute_series(views.metrics(spark, sf_dir), TODAY, AS_OF), "calls", 60)


@QUERIES.add("peak_minute", sql(f"""SELECT t, CAST(calls AS BIGINT) AS calls FROM (SELECT t, sum(calls) AS calls FROM v_metric
    WHERE t >= {TODAY.start} AND t < {TODAY.end} GROUP BY t) ORDER BY calls DESC, t LIMIT 1"""))
def peak_minute(spark, sf_dir):
    return metrics.peak_minute(views.metrics(spark, sf_dir), TODAY.start, TODAY.end)


@QUERIES.add("freshness", sql(f"""SELECT max(t) AS as_of, {END + DAY * 30} - max(t) - 60000 AS age_ms, {END + DAY * 30} - max(t) - 60000 > 15 * 60000 AS stale FROM v_metric"""))
def freshness(spark, sf_dir):
    return metrics.freshness(views.metrics(spark, sf_dir), END + DAY * 30)


@QUERIES.add("range_stages", sql(f"""SELECT *, {_pct('calls', '(sum(calls) OVER ())')} AS share, {_pct('err_4xx', 'calls')} AS err_4xx_pct,
    {_pct('err_5xx', 'calls')} AS err_5xx_pct, round(p95 - ip95, 1) AS gateway_ms
    FROM (SELECT api, stage, {_sums()} FROM v_metric WHERE t >= {START} AND t < {END} GROUP BY api, stage)"""))
def range_stages(spark, sf_dir):
    return metrics.range_stages(views.metrics(spark, sf_dir), START, END)


_B = metrics.range_buckets(START, END, "EST")


@QUERIES.add("range_report", sql(f"""WITH c AS (SELECT unnest(range({_B.first}, {_B.first + _B.step * _B.count}, {_B.step})) AS t),
    s AS (SELECT (t - {_B.first}) // {_B.step} * {_B.step} + {_B.first} AS t, {_sums()} FROM v_metric WHERE t >= {START} AND t < {END}
          GROUP BY 1),
    a AS (SELECT max(t) AS as_of FROM v_metric WHERE t >= {START} AND t < {END})
    SELECT c.t, {', '.join(f'CASE WHEN c.t >= {START} AND c.t + {_B.step} <= least({END}, as_of + 60000) THEN coalesce({x}, 0) END AS {x}'
                           for x in ('calls', 'err_4xx', 'err_5xx'))}, p95, ip95 FROM c LEFT JOIN s USING (t), a"""))
def range_report(spark, sf_dir):
    return metrics.range_series(views.metrics(spark, sf_dir), START, END, "EST")


@QUERIES.add("metric_pivot", sql("""SELECT strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%MZ') AS minute, api, stage, calls, err_4xx, err_5xx,
    round(p50, 1) AS latency_p50_ms, round(p95, 1) AS latency_p95_ms, round(ip95, 1) AS integration_p95_ms FROM v_metric"""))
def metric_pivot(spark, sf_dir):
    wide = views.metrics(spark, sf_dir)
    points = wide.select(
        F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm'Z'").alias("minute"), "api", "stage",
        F.explode(F.expr("""array(
            named_struct('metric', 'Count', 'statistic', 'Sum', 'value', double(calls)),
            named_struct('metric', '4XXError', 'statistic', 'Sum', 'value', double(err_4xx)),
            named_struct('metric', '5XXError', 'statistic', 'Sum', 'value', double(err_5xx)),
            named_struct('metric', 'Latency', 'statistic', 'p50', 'value', p50),
            named_struct('metric', 'Latency', 'statistic', 'p95', 'value', p95),
            named_struct('metric', 'IntegrationLatency', 'statistic', 'p95', 'value', ip95))""")).alias("p"))
    return metrics.metric_pivot(points.select("minute", "api", "stage", "p.*"))


# ---- orders
_S0 = 852076800000          # 1997-01-01
SALE, SALE_WEEK = zone_day(date(1999, 6, 15), "EST"), zone_day(date(1999, 6, 8), "EST")


@QUERIES.add("orders_first_seen", sql("SELECT service, store, order_id, min(ms) AS first_ms FROM v_sighting GROUP BY ALL"))
def orders_first_seen(spark, sf_dir):
    return orders.first_seen(views.sightings(spark, sf_dir))


@QUERIES.add("orders_by_store", sql("""SELECT service, store, count(*) AS orders FROM (SELECT service, store, order_id
    FROM v_sighting GROUP BY ALL) GROUP BY ALL"""))
def orders_by_store(spark, sf_dir):
    return orders.counts(orders.first_seen(views.sightings(spark, sf_dir)), ("service", "store"))


@QUERIES.add("orders_by_hour", sql("""SELECT service, first_ms // 3600000 * 3600000 AS t, count(*) AS orders FROM (
    SELECT service, store, order_id, min(ms) AS first_ms FROM v_sighting GROUP BY ALL) GROUP BY ALL"""))
def orders_by_hour(spark, sf_dir):
    return orders.per_hour(orders.first_seen(views.sightings(spark, sf_dir)), 0)


@QUERIES.add("orders_per_minute", sql(f"""SELECT first_ms // 60000 * 60000 AS t, count(*) AS orders FROM (
    SELECT service, store, order_id, min(ms) AS first_ms FROM v_sighting WHERE ms // {DAY} IN ({SALE.start // DAY}, {SALE.start // DAY + 1})
    GROUP BY ALL) WHERE first_ms >= {SALE.start} AND first_ms < {SALE.end} GROUP BY 1"""))
def orders_per_minute(spark, sf_dir):
    """A zone's day out of the two UTC days it overlaps."""
    by_day = orders.first_seen_by_utc_day(views.sightings(spark, sf_dir))
    return orders.per_minute(orders.zone_first_seen(by_day, SALE), SALE.start)


def _zone_firsts(d) -> str:
    return (f"SELECT service, store, order_id, min(ms) AS first_ms FROM v_sighting WHERE ms // {DAY} IN ({d.start // DAY}, "
            f"{d.start // DAY + 1}) GROUP BY ALL HAVING min(ms) >= {d.start} AND min(ms) < {d.end}")


_SALE_AS_OF = SALE.start + 15 * HOUR


@QUERIES.add("orders_wow", sql(f"""WITH a AS (SELECT service, store, count(*) AS orders FROM ({_zone_firsts(SALE)})
      WHERE first_ms <= {_SALE_AS_OF} GROUP BY ALL),
    b AS (SELECT service, store, count(*) FILTER (first_ms < {_SALE_AS_OF + MINUTE - WEEK}) AS lw_orders, count(*) AS lw_day_orders
          FROM ({_zone_firsts(SALE_WEEK)}) GROUP BY ALL)
    SELECT service, store, store AS name, coalesce(orders, 0) AS orders, coalesce(lw_orders, 0) AS lw_orders,
           coalesce(lw_day_orders, 0) AS lw_day_orders, {_change('coalesce(orders, 0)', 'coalesce(lw_orders, 0)')} AS change
    FROM a FULL JOIN b USING (service, store)"""))
def orders_wow(spark, sf_dir):
    by_day = orders.first_seen_by_utc_day(views.sightings(spark, sf_dir))
    return orders.week_over_week(by_day, SALE, SALE_WEEK, _SALE_AS_OF)


@QUERIES.add("orders_range", sql(f"""SELECT service, (first_ms - {_S0}) // {DAY} * {DAY} + {_S0} AS t, count(*) AS orders FROM (
    SELECT service, store, order_id, min(ms) AS first_ms FROM v_sighting
    WHERE ms // {DAY} >= {_S0 // DAY} AND ms // {DAY} <= {(_S0 + 20 * DAY - 1) // DAY} GROUP BY ALL)
    WHERE first_ms >= {_S0} AND first_ms < {_S0 + 20 * DAY} GROUP BY ALL"""))
def orders_range(spark, sf_dir):
    by_day = orders.first_seen_by_utc_day(views.sightings(spark, sf_dir))
    return orders.range_counts(by_day, _S0, _S0 + 20 * DAY, _S0, DAY)


ORDER_LINES = [
    orders.OrderLine("purchase user", r"^purchase user (\d+) .*(\d)\}$", {"order": 1, "tenant": 2}, {"tenant": ["7"]}),
    orders.OrderLine("user", r"^(click|signup) user (\d+) \{.k.: (\d+)", {"order": 2, "store": 1, "k": 3}),
]


@QUERIES.add("order_lines", sql(r"""SELECT 'shop' AS service,
      CASE WHEN msg LIKE 'purchase%' THEN coalesce(CASE regexp_extract(msg, '(\d)\}$', 1) WHEN '1' THEN 'one' END,
                regexp_extract(msg, '(\d)\}$', 1)) ELSE split_part(msg, ' ', 1) END AS store,
      split_part(msg, ' ', 3) AS order_id, min(log_time_ms) AS first_ms
    FROM v_logs WHERE (msg LIKE 'purchase%' AND regexp_extract(msg, '(\d)\}$', 1) <> '7') OR msg LIKE 'click%' OR msg LIKE 'signup%'
    GROUP BY ALL"""))
def order_lines(spark, sf_dir):
    """Orders out of log lines by patterns, first match wins, then their first sighting."""
    seen = orders.extract_orders(views.logs(spark, sf_dir), "shop", ORDER_LINES, {"1": "one"})
    return orders.first_seen(seen)


# ---- inbound windows
_ID, _ILW = zone_day(date(1998, 3, 12), "IST"), zone_day(date(1998, 3, 5), "IST")
_IUPTO = _ID.start + 16 * HOUR
_EXCLUDE = ["shop7", "^shop1\\."]
_OUT = "tenant NOT LIKE '%shop7%' AND tenant NOT LIKE 'shop1.%'"


@QUERIES.add("inbound_as_of", sql(f"""SELECT min(t) AS t FROM (SELECT source, max(t) AS t FROM v_inbound WHERE t >= {_ID.start}
    AND t < {_ID.end} GROUP BY source)"""))
def inbound_as_of(spark, sf_dir):
    return inbound.as_of(views.inbound(spark, sf_dir), _ID.start, _ID.end)


@QUERIES.add("inbound_day", sql(f"""SELECT *, {_change('orders', 'lw_orders')} AS change, upper(left(tenant, 1)) || split_part(substr(tenant, 2), '.', 1) AS name
    FROM (SELECT tenant, CAST(coalesce(sum(orders) FILTER (t >= {_ID.start} AND t < {_IUPTO}), 0) AS BIGINT) AS orders,
                 CAST(coalesce(sum(orders) FILTER (t >= {_ILW.start} AND t < {_IUPTO - WEEK}), 0) AS BIGINT) AS lw_orders,
                 CAST(coalesce(sum(orders) FILTER (t >= {_ILW.start} AND t < {_ILW.end}), 0) AS BIGINT) AS lw_day_orders
          FROM v_inbound WHERE {_OUT} GROUP BY tenant) WHERE orders > 0 OR lw_orders > 0"""))
def inbound_day(spark, sf_dir):
    return inbound.inbound_day(views.inbound(spark, sf_dir), _ID, _ILW, _IUPTO, _EXCLUDE)


@QUERIES.add("inbound_hours", sql(f"""SELECT tenant, (t - {_ID.start}) // {HOUR} * {HOUR} + {_ID.start} AS t, CAST(sum(orders) AS BIGINT) AS orders
    FROM v_inbound WHERE t >= {_ID.start} AND t < {_IUPTO} AND {_OUT} GROUP BY 1, 2"""))
def inbound_hours(spark, sf_dir):
    return inbound.inbound_hours(views.inbound(spark, sf_dir), _ID, _IUPTO, _EXCLUDE)


_IS, _IE = _ID.start + 100 * MINUTE, _ID.start + 9 * DAY
_IB = inbound.range_buckets(_IS, _IE, "PST")


@QUERIES.add("inbound_range", sql(f"""WITH r AS (SELECT * FROM v_inbound WHERE t >= {_IS} AND t < {_IE}),
    u AS (SELECT least({_IE}, (SELECT min(t) FROM (SELECT max(t) AS t FROM r GROUP BY source)) + 300000) AS upto,
                 greatest({_IS}, (SELECT min(t) FROM r)) AS lo),
    c AS (SELECT unnest(range({_IB.first}, {_IB.first + _IB.step * _IB.count}, {_IB.step})) AS t),
    s AS (SELECT (t - {_IB.first}) // {_IB.step} * {_IB.step} + {_IB.first} AS t, CAST(sum(orders) AS BIGINT) AS orders FROM r WHERE {_OUT} GROUP BY 1)
    SELECT c.t, CASE WHEN c.t >= lo AND c.t + {_IB.step} <= upto THEN coalesce(orders, 0) END AS orders FROM c LEFT JOIN s USING (t), u"""))
def inbound_range(spark, sf_dir):
    return inbound.inbound_range(views.inbound(spark, sf_dir), _IS, _IE, "PST", _EXCLUDE)


@QUERIES.add("inbound_tenants", sql(f"""SELECT tenant, CAST(sum(orders) AS BIGINT) AS orders FROM v_inbound WHERE t >= {_IS} AND t < {_IE}
    AND {_OUT} GROUP BY tenant"""))
def inbound_tenants(spark, sf_dir):
    return inbound.inbound_tenants(views.inbound(spark, sf_dir), _IS, _IE, _EXCLUDE)


DELTA = sql("""WITH r AS (SELECT snapshot_ms, lag(snapshot_ms) OVER (ORDER BY snapshot_ms) AS previous_ms
        FROM (SELECT DISTINCT snapshot_ms FROM v_snap)),
    n AS (SELECT s.snapshot_ms, r.previous_ms, s.tenant, s.docs_count,
                 CASE WHEN p.docs_count IS NOT NULL THEN greatest(0, s.docs_count - p.docs_count)
                      WHEN s.creation_ms >= r.previous_ms - 60000 THEN s.docs_count ELSE 0 END AS fresh
          FROM v_snap s JOIN r ON r.snapshot_ms = s.snapshot_ms AND r.previous_ms IS NOT NULL
          LEFT JOIN v_snap p ON p.index = s.index AND p.snapshot_ms = r.previous_ms WHERE s.variant IS NULL),
    t AS (SELECT snapshot_ms, previous_ms, tenant, CAST(sum(fresh) AS BIGINT) AS orders, CAST(sum(docs_count) AS BIGINT) AS docs FROM n GROUP BY ALL)
    SELECT previous_ms // 300000 * 300000 AS t, tenant, orders, docs, CAST((snapshot_ms - previous_ms) / 60000 AS BIGINT) AS span_min, 'live' AS src,
           snapshot_ms AS at FROM t WHERE orders > 0
    UNION ALL SELECT previous_ms // 300000 * 300000, '_all', CAST(coalesce(sum(orders), 0) AS BIGINT), CAST(coalesce(sum(docs), 0) AS BIGINT),
              CAST((r.snapshot_ms - previous_ms) / 60000 AS BIGINT), 'live', r.snapshot_ms
              FROM r LEFT JOIN t USING (snapshot_ms, previous_ms) WHERE previous_ms IS NOT NULL GROUP BY r.snapshot_ms, previous_ms""")


@QUERIES.add("inbound_delta", DELTA)
def inbound_delta(spark, sf_dir):
    return inbound.inbound_delta(views.index_snapshots(spark, sf_dir))


_LATEST = "v_last AS (SELECT index, max(docs_count) AS docs_count, any_value(tenant) AS tenant, any_value(variant) AS variant FROM v_snap GROUP BY index)"


@QUERIES.add("order_index_groups", sql(f"""WITH {_LATEST} SELECT tenant, CAST(right(index, 4) AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month,
    CAST(sum(docs_count) AS BIGINT) AS total, count(*) AS parts FROM v_last WHERE variant IS NULL GROUP BY ALL"""))
def order_index_groups(spark, sf_dir):
    rows = inbound.group_order_indexes(_latest(spark, sf_dir))
    return rows.withColumn("parts", F.size("parts").cast("bigint"))


def _latest(spark, sf_dir):
    snap = views.index_snapshots(spark, sf_dir)
    return snap.groupBy("index", "status").agg(F.max("docs_count").alias("docs_count"))


@QUERIES.add("order_index_summary", sql(f"""WITH {_LATEST} SELECT count(DISTINCT tenant) FILTER (variant IS NULL) AS tenants,
    count(*) FILTER (variant IS NULL) AS rows, count(*) FILTER (variant IS NULL) AS indexes,
    CAST(sum(docs_count) FILTER (variant IS NULL) AS BIGINT) AS orders, count(*) FILTER (variant IS NOT NULL) AS skipped,
    CAST(0 AS BIGINT) AS unmatched, CAST(0 AS BIGINT) AS closed FROM v_last"""))
def order_index_summary(spark, sf_dir):
    return inbound.index_summary(_latest(spark, sf_dir))


_D0 = 820454400000          # 1996-01-01


@QUERIES.add("inbound_backfill", sql(f"""WITH o AS (SELECT o_custkey % 12 AS shop, o_orderkey AS k,
        epoch_ms(o_orderdate) + o_custkey % 288 * 300000 AS ms FROM orders),
    d AS (SELECT shop, coalesce(CASE WHEN k % 3 = 0 THEN ms END, CASE WHEN k % 3 <= 1 THEN ms + 3600000 END,
                                CASE WHEN k % 7 <> 0 THEN ms + 7200000 END) AS placed FROM o),
    t AS (SELECT placed // 300000 * 300000 AS t, 'shop' || shop || '.myshopify.com' AS tenant, count(*) AS orders FROM d
          WHERE placed >= {_D0} AND placed < {_D0 + 30 * DAY} AND shop <> 3 GROUP BY ALL),
    c AS (SELECT unnest(range({_D0}, {_D0 + 30 * DAY}, 300000)) AS t)
    SELECT t, tenant, orders, CAST(5 AS BIGINT) AS span_min, 'backfill' AS src FROM t
    UNION ALL SELECT c.t, '_all', CAST(coalesce(sum(orders), 0) AS BIGINT), 5, 'backfill' FROM c LEFT JOIN t USING (t) GROUP BY c.t"""))
def inbound_backfill(spark, sf_dir):
    return inbound.inbound_backfill(views.dated_orders(spark, sf_dir), ["d1", "d2", "d3"], _D0, _D0 + 30 * DAY)


@QUERIES.add("inbound_compare", sql("""SELECT tenant, coalesce(live, 0) AS live, coalesce(by_date, 0) AS by_date FROM
    (SELECT tenant, CAST(sum(orders) AS BIGINT) AS live FROM v_inbound WHERE source = 0 GROUP BY 1) FULL JOIN
    (SELECT tenant, CAST(sum(orders) AS BIGINT) AS by_date FROM v_inbound WHERE source = 1 GROUP BY 1) USING (tenant)"""))
def inbound_compare(spark, sf_dir):
    rows = views.inbound(spark, sf_dir)
    return inbound.compare_with_dates(rows.filter("source = 0"), rows.filter("source = 1"))




# ---- the summary of a day in progress and the report of a finished one
def _summary(spark, sf_dir, part, day=TODAY, before=LAST_WEEK, as_of=AS_OF):
    by_day = orders.first_seen_by_utc_day(views.sightings(spark, sf_dir))
    return reports.ops_summary(views.metrics(spark, sf_dir), by_day, views.inbound(spark, sf_dir), day, before, as_of, THRESHOLDS, _EXCLUDE)[part]


@QUERIES.add("ops_summary_stages", sql(f"""WITH {_judge(_weeks((TODAY.start, _UPTO), (LAST_WEEK.start, _CUT)))}
    SELECT api, stage, calls, lw_calls, p95, status, reasons, {_change('calls', 'lw_calls')} AS change FROM j"""))
def ops_summary_stages(spark, sf_dir):
    rows = _summary(spark, sf_dir, "stages")
    return rows.select("api", "stage", "calls", "lw_calls", "p95", "status", F.array_join("reasons", "; ").alias("reasons"), "change")


@QUERIES.add("ops_summary_peak", sql(f"""SELECT arg_max(t, (calls, -t)) AS t, CAST(max(calls) AS BIGINT) AS calls FROM (
    SELECT t, sum(calls) AS calls FROM v_metric WHERE t >= {TODAY.start} AND t < {_UPTO} GROUP BY t)"""))
def ops_summary_peak(spark, sf_dir):
    return _summary(spark, sf_dir, "peak")


@QUERIES.add("ops_summary_orders", sql(f"""SELECT service, coalesce(orders, 0) AS orders, coalesce(lw_orders, 0) AS lw_orders, coalesce(lw_day_orders, 0) AS lw_day_orders,
        {_change('coalesce(orders, 0)', 'coalesce(lw_orders, 0)')} AS change
    FROM (SELECT service, count(*) AS orders FROM ({_zone_firsts(SALE)}) WHERE first_ms <= {_SALE_AS_OF} GROUP BY ALL)
    FULL JOIN (SELECT service, count(*) FILTER (first_ms < {_SALE_AS_OF + MINUTE - WEEK}) AS lw_orders, count(*) AS lw_day_orders
               FROM ({_zone_firsts(SALE_WEEK)}) GROUP BY ALL) USING (service)"""))
def ops_summary_orders(spark, sf_dir):
    return _summary(spark, sf_dir, "orders", SALE, SALE_WEEK, _SALE_AS_OF)


@QUERIES.add("ops_summary_inbound", sql(f"""SELECT *, {_change('orders', 'lw_orders')} AS change, upper(left(tenant, 1)) || split_part(substr(tenant, 2), '.', 1) AS name
    FROM (SELECT tenant, CAST(coalesce(sum(orders) FILTER (t BETWEEN {_ID.start} AND {_IUPTO}), 0) AS BIGINT) AS orders,
                 CAST(coalesce(sum(orders) FILTER (t BETWEEN {_ILW.start} AND {_IUPTO - WEEK}), 0) AS BIGINT) AS lw_orders,
                 CAST(coalesce(sum(orders) FILTER (t >= {_ILW.start} AND t < {_ILW.end}), 0) AS BIGINT) AS lw_day_orders
          FROM v_inbound WHERE {_OUT} GROUP BY tenant) WHERE orders > 0 OR lw_orders > 0"""))
def ops_summary_inbound(spark, sf_dir):
    return _summary(spark, sf_dir, "inbound", _ID, _ILW, _IUPTO)


def _history_sql(test: str) -> str:
    def day(d, shift):
        return (f"SELECT (first_ms - {d.start}) // 60000 * 60000 + {d.start + shift} AS t, count(*) AS n FROM ({_zone_firsts(d)}) "
                f"WHERE {test} GROUP BY 1")
    return sql(f"""SELECT c.t, CASE WHEN c.t <= {_SALE_AS_OF} THEN coalesce(a.n, 0) END AS orders, coalesce(b.n, 0) AS lw_orders
        FROM (SELECT unnest(range({SALE.start}, {SALE.end}, 60000)) AS t) c LEFT JOIN ({day(SALE, 0)}) a USING (t) LEFT JOIN ({day(SALE_WEEK, WEEK)}) b USING (t)""")


@QUERIES.add("order_history_service", _history_sql("service = (SELECT min(service) FROM v_sighting)"))
def order_history_service(spark, sf_dir):
    seen = views.sightings(spark, sf_dir)
    first = seen.agg(F.min("service")).first()[0]
    return reports.order_history(orders.first_seen_by_utc_day(seen), SALE, SALE_WEEK, service=first, as_of=_SALE_AS_OF)


@QUERIES.add("order_history_store", _history_sql("store = (SELECT max(store) FROM v_sighting)"))
def order_history_store(spark, sf_dir):
    seen = views.sightings(spark, sf_dir)
    last = seen.agg(F.max("store")).first()[0]
    return reports.order_history(orders.first_seen_by_utc_day(seen), SALE, SALE_WEEK, store=last, as_of=_SALE_AS_OF)


def _report(spark, sf_dir, part, day=TODAY, before=LAST_WEEK):
    firsts = orders.first_seen(views.sightings(spark, sf_dir))
    return reports.daily_report(views.metrics(spark, sf_dir), firsts, views.alert_events(spark, sf_dir), day, before, THRESHOLDS)[part]


@QUERIES.add("daily_report_kpi", sql(f"""SELECT *, {_pct('err_4xx', 'calls')} AS err_4xx_pct, {_pct('err_5xx', 'calls')} AS err_5xx_pct, {_change('calls', 'lw_calls')} AS change FROM (
    SELECT {', '.join(f"CAST(sum({c}) FILTER (t >= {TODAY.start} AND t < {TODAY.end}) AS BIGINT) AS {c}" for c in ('calls', 'err_4xx', 'err_5xx'))},
           CAST(sum(calls) FILTER (t >= {LAST_WEEK.start} AND t < {LAST_WEEK.end}) AS BIGINT) AS lw_calls FROM v_metric)"""))
def daily_report_kpi(spark, sf_dir):
    return _report(spark, sf_dir, "kpi")


def _sold(keys: str) -> str:
    return f"""SELECT *, {_change('orders', 'lw_orders')} AS change FROM (
        SELECT {keys}, count(*) FILTER (ms >= {SALE.start} AND ms < {SALE.end}) AS orders, count(*) FILTER (ms >= {SALE_WEEK.start} AND ms < {SALE_WEEK.end}) AS lw_orders
        FROM (SELECT service, store, order_id, min(ms) AS ms FROM v_sighting GROUP BY ALL) GROUP BY {keys})"""


@QUERIES.add("daily_report_services", sql(f"{_sold('service')} WHERE orders > 0 OR lw_orders > 0"))
def daily_report_services(spark, sf_dir):
    return _report(spark, sf_dir, "services", SALE, SALE_WEEK)


@QUERIES.add("daily_report_stores", sql(f"{_sold('service, store')} WHERE orders > 0 ORDER BY orders DESC, store, service LIMIT 8"))
def daily_report_stores(spark, sf_dir):
    return _report(spark, sf_dir, "stores", SALE, SALE_WEEK)


@QUERIES.add("daily_report_recap", sql(f"""WITH d AS (SELECT * FROM v_alert WHERE at_ms >= {TODAY.start} AND at_ms < {TODAY.end} AND event IN ('firing', 'escalated'))
    SELECT count(*) FILTER (event = 'firing') AS started,
           (SELECT count(*) FROM (SELECT DISTINCT rule_id, subject FROM d WHERE event = 'escalated' OR level = 'critical')) AS critical FROM d"""))
def daily_report_recap(spark, sf_dir):
    return _report(spark, sf_dir, "recap")
