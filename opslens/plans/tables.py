"""Table maintenance: merging, replacing and adding windows, coverage, retention, conversion ledger."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, MINUTE
from ..operators import access, lb, orders
from ..operators.lb import RequestQuery, RequestTables
from ..sources import writers
from . import views
from .oracle import sql
from .registry import Registry

QUERIES = Registry()

T0 = 1704067200000
_METRIC = "t, api, stage, calls, err_4xx, err_5xx"


@QUERIES.add("upsert_newest", sql(f"""WITH o AS (SELECT {_METRIC} FROM v_metric WHERE t < {T0 + 20 * DAY}),
    f AS (SELECT t, api, stage, calls + 1 AS calls, err_4xx, err_5xx FROM v_metric WHERE t >= {T0 + 15 * DAY})
    SELECT * FROM f UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = o.t AND f.api = o.api AND f.stage = o.stage)"""))
def upsert_newest(spark, sf_dir):
    rows = views.metrics(spark, sf_dir).select(*_METRIC.split(", "))
    fresh = rows.filter(F.col("t") >= T0 + 15 * DAY).withColumn("calls", F.col("calls") + 1)
    return writers.upsert_newest(rows.filter(F.col("t") < T0 + 20 * DAY), fresh, ["t", "api", "stage"])


@QUERIES.add("replace_windows", sql(f"""SELECT {_METRIC} FROM v_metric WHERE NOT (t >= {T0 + 5 * DAY} AND t < {T0 + 9 * DAY})
    UNION ALL SELECT t, api, stage, calls * 2, err_4xx, err_5xx FROM v_metric WHERE t >= {T0 + 5 * DAY} AND t < {T0 + 9 * DAY}"""))
def replace_windows(spark, sf_dir):
    rows = views.metrics(spark, sf_dir).select(*_METRIC.split(", "))
    fresh = rows.filter(F.col("t") >= T0 + 4 * DAY).withColumn("calls", F.col("calls") * 2)
    return writers.replace_windows(rows, fresh, T0 + 5 * DAY, T0 + 9 * DAY)


@QUERIES.add("add_windows", sql("""SELECT t // 86400000 * 86400000 AS t, tenant, CAST(sum(orders) AS BIGINT) AS orders, CAST(count(*) * 5 AS BIGINT) AS span_min,
    max(source) + 10 AS docs, max(source) AS at, 'live' AS src FROM v_inbound GROUP BY 1, 2"""))
def add_windows(spark, sf_dir):
    """Two runs counting the same windows (here: days) add up; the later document count stays."""
    rows = views.inbound(spark, sf_dir).filter("tenant <> '_all'").selectExpr(
        "t - pmod(t, 86400000) AS t", "tenant", "orders", "5L AS span_min", "source + 10 AS docs", "source AS at", "'live' AS src")
    return writers.add_windows(rows.filter("at = 0"), rows.filter("at = 1"))


_FILES = "SELECT 'elb-' || l_suppkey % 4 AS lb, (epoch_ms(l_shipdate) + l_partkey % 1440 * 60000 - 60000) // 3600000 * 3600000 AS hour_ms, " \
         "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, l_quantity FROM lineitem"
_S0, _S1 = 902000000000, 912000000000


def _files(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").selectExpr(
        "'elb-' || l_suppkey % 4 AS lb", "unix_millis(CAST(l_shipdate AS TIMESTAMP)) + l_partkey % 1440 * 60000 - 60000 AS ms",
        "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path", "l_quantity").selectExpr("lb", "ms - pmod(ms, 3600000) AS hour_ms", "path", "l_quantity")


@QUERIES.add("coverage", sql(f"""SELECT *, files - converted AS pending FROM (SELECT lb, hour_ms, count(*) AS files, count(*) FILTER (l_quantity < 40) AS converted
    FROM ({_FILES}) WHERE hour_ms BETWEEN {_S0 // HOUR * HOUR} AND {_S1} AND hour_ms + 3600000 + 1200000 <= {_S1 - 5 * DAY} GROUP BY lb, hour_ms)"""))
def coverage(spark, sf_dir):
    listed = _files(spark, sf_dir)
    return writers.coverage(listed.drop("l_quantity"), listed.filter("l_quantity < 40").select("path"), _S0, _S1, _S1 - 5 * DAY)


@QUERIES.add("pending_files", sql(f"SELECT lb, hour_ms, path FROM ({_FILES}) WHERE l_quantity >= 40"))
def pending_files(spark, sf_dir):
    listed = _files(spark, sf_dir)
    return writers.pending_files(listed.drop("l_quantity"), listed.filter("l_quantity < 40")).select("lb", "hour_ms", "path")


@QUERIES.add("retention", sql("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders WHERE o_orderdate > DATE '1998-06-15' - 30 - 1"))
def retention(spark, sf_dir):
    now = 897868800000                                           # 1998-06-15
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt"))
    return rows.filter(writers.kept("dt", now, 30))


@QUERIES.add("export_report", sql(f"""WITH m AS (SELECT log_time_ms FROM v_logs WHERE level = 'ERROR'), r AS (SELECT * FROM m ORDER BY log_time_ms DESC LIMIT 500)
    SELECT count(*) AS rows, min(log_time_ms) AS first_ms, max(log_time_ms) AS last_ms, (SELECT count(*) FROM m) AS total FROM r"""))
def export_report(spark, sf_dir):
    matches = views.logs(spark, sf_dir).filter("level = 'ERROR'").select("log_time_ms", "row_id")
    return writers.export_report(matches, matches.orderBy(F.desc("log_time_ms"), F.desc("row_id")).limit(500))


@QUERIES.add("newest_versions", sql("""SELECT user_id, event_type, arg_max(value, batch) AS value FROM (SELECT user_id, event_type, value, event_id AS batch FROM events)
    GROUP BY user_id, event_type"""))
def newest_versions(spark, sf_dir):
    """Reading a table written batch by batch: the newest version of every key."""
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("batch"))
    return writers.read_newest(rows, ["user_id", "event_type"])


@QUERIES.add("first_seen_by_day", sql(f"""SELECT CAST(make_timestamp(ms // {DAY} * {DAY} * 1000) AS DATE) AS day, service, store, order_id, min(ms) AS first_ms
    FROM v_sighting GROUP BY ALL"""))
def first_seen_by_day(spark, sf_dir):
    return orders.first_seen_by_utc_day(views.sightings(spark, sf_dir))


@QUERIES.add("merge_late_hours", sql("""SELECT hour_ms, count(*) AS n, round(sum(tgt_t), 6) AS tgt_t_sum FROM
    (SELECT *, ts_ms // 3600000 * 3600000 AS hour_ms FROM v_req) WHERE hour_ms IN (SELECT DISTINCT ts_ms // 3600000 * 3600000 FROM v_req WHERE lb = 'lb-2')
    GROUP BY hour_ms"""))
def merge_late_hours(spark, sf_dir):
    """A late part (one balancer's rows) touches hours: their roll-ups come from all rows of those hours, not from adding."""
    hour = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(HOUR))
    rows = views.requests(spark, sf_dir).withColumn("hour_ms", hour)
    touched = rows.filter("lb = 'lb-2'").select("hour_ms").distinct()
    rollup = access.minute_rollup(rows.join(touched, "hour_ms", "left_semi"))
    return (rollup.groupBy((F.col("minute_ms") - F.pmod(F.col("minute_ms"), F.lit(HOUR))).alias("hour_ms"))
            .agg(F.sum("n").alias("n"), F.round(F.sum("tgt_t_sum"), 6).alias("tgt_t_sum")))


@QUERIES.add("lb_page_unmerged", sql(f"""SELECT ts_ms, lb, trace_id FROM v_req WHERE ts_ms BETWEEN {T0 + DAY} AND {T0 + 29 * DAY}
    ORDER BY ts_ms DESC, trace_id LIMIT 100 OFFSET 400"""))
def lb_page_unmerged(spark, sf_dir):
    """A page over finished hours and rows of hours not merged yet."""
    rows = views.requests(spark, sf_dir)
    cut = T0 + 27 * DAY + 30 * MINUTE
    done, rest = rows.filter(F.col("ts_ms") < cut), rows.filter(F.col("ts_ms") >= cut)
    both = RequestTables(done, access.minute_rollup(done), access.path_rollup(done), rest)
    return lb.request_page(RequestQuery(T0 + DAY, T0 + 29 * DAY), both, 100, 400).select("ts_ms", "lb", "trace_id")
