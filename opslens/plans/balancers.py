"""Access log conversion and load balancer queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import web
from ..functions.times import DAY, HOUR
from ..operators import access, lb
from ..operators.lb import Access, LongSteps, RequestQuery, RequestTables
from . import views
from .oracle import percentile_sql, sql
from .registry import Registry

QUERIES = Registry()

START, END = 1704067200000 + DAY + 12_345, 1704067200000 + 28 * DAY + 54_321
FIRST_MINUTE = START // 60_000 * 60_000
TIMED = f"ts_ms BETWEEN {START} AND {END}"
ROLLED = f"minute_ms BETWEEN {FIRST_MINUTE} AND {END}"
ROUND = 6


def _query(**filters) -> RequestQuery:
    return RequestQuery(START, END, **filters)


def tables(spark, sf_dir) -> RequestTables:
    requests = views.requests(spark, sf_dir)
    return RequestTables(requests, access.minute_rollup(requests), access.path_rollup(requests))


_ROLLED_UNTIL = 1704067200000 + 20 * DAY


def _rolled_day(time: str) -> str:
    """Days that have longer steps here: all of lb-0, and the first twenty of lb-1."""
    return f"(lb = 'lb-0' OR lb = 'lb-1' AND {time} < {_ROLLED_UNTIL})"


def long_tables(spark, sf_dir) -> RequestTables:
    """Some days rolled up by hour and day, the others in minutes only."""
    t = tables(spark, sf_dir)

    def steps(rollup):
        hours = access.coarser(rollup.filter(_rolled_day("minute_ms")), HOUR)
        return LongSteps(hours, access.coarser(hours, DAY), rollup.filter(f"NOT {_rolled_day('minute_ms')}"))
    return RequestTables(t.requests, t.minutes, t.paths, None, steps(t.minutes), steps(t.paths))


# ---- URLs and raw lines
@QUERIES.add("url_parts", sql(r"""SELECT page_id, url, path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query
    FROM (SELECT *, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path
          FROM pages)"""))
def url_parts(spark, sf_dir):
    pages = access.with_url_parts(views.table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "path", "query")


@QUERIES.add("path_groups", sql(r"""SELECT g AS path_group, count(*) AS n FROM (
      SELECT regexp_replace(regexp_replace(p, '/[0-9]+(/|$)', '/<n>\1', 'g'), '/[0-9]+(/|$)', '/<n>\1', 'g') AS g
      FROM (SELECT coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS p
            FROM pages)) GROUP BY g"""))
def path_groups(spark, sf_dir):
    pages = access.with_url_parts(views.table(spark, sf_dir, "pages"))
    return pages.groupBy("path_group").agg(F.count("*").alias("n"))


@QUERIES.add("short_paths", sql(r"""SELECT regexp_replace(split_part(url, '?', 1), '/[0-9a-f-]{8,}|/\d+', '/…', 'g') AS short,
    count(*) AS n FROM pages GROUP BY 1"""))
def short_paths(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return pages.groupBy(web.short_path(F.col("url")).alias("short")).agg(F.count("*").alias("n"))


@QUERIES.add("access_parse", sql(r"""
    SELECT epoch_us(ts) // 1000 AS ts_ms, 'elb-' || user_id % 3 AS lb,
           CASE WHEN user_id % 4 = 0 THEN 'webhook-' || user_id % 3 ELSE 'tg-c' || user_id % 8 END AS tg,
           CASE WHEN user_id % 4 = 0 THEN 'webhook-' || user_id % 3 ELSE 'c' || user_id % 8 END AS cluster,
           CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END AS method,
           '/v1/s' || user_id % 6 || '.myshopify.com/' || event_type || '/' || event_id AS path,
           '/v1/<store>/' || event_type || '/<n>' AS path_group,
           CASE WHEN event_id % 3 = 0 THEN 'x=' || user_id END AS query,
           'HTTP/1.1' AS protocol, CAST(CASE WHEN event_id % 13 = 0 THEN 503 ELSE 200 END AS SMALLINT) AS elb_code,
           CAST(CASE WHEN event_id % 13 = 0 THEN NULL ELSE 200 END AS SMALLINT) AS tgt_code,
           '198.51.100.' || user_id % 250 AS client_ip, CAST(1024 + event_id % 50000 AS INTEGER) AS client_port,
           CASE WHEN event_id % 13 <> 0 THEN '10.0.32.' || user_id % 20 || ':80' END AS target,
           CASE WHEN event_id % 13 <> 0 THEN 0.001::DOUBLE END AS req_t,
           CASE WHEN event_id % 13 <> 0 THEN CAST(user_id * 10 + event_id % 10 AS DOUBLE) END AS tgt_t,
           100 + event_id % 900 AS rx, event_id * 3 AS tx,
           CASE WHEN event_id % 7 = 0 THEN 'Mozilla/5.0 (X11; \"q\") Demo' ELSE 'curl/8' END AS user_agent,
           'Root=1-' || event_id AS trace_id, 'forward' AS actions, CAST(NULL AS VARCHAR) AS error_reason,
           '10' AS rule_priority, 'TLSv1.2' AS ssl_protocol
    FROM events"""))
def access_parse(spark, sf_dir):
    """Every line of the rendered access log, through the tokeniser."""
    rows = access.parse_requests(views.access_lines(spark, sf_dir))
    return rows.select("ts_ms", "lb", "tg", "cluster", "method", "path", "path_group", "query", "protocol", "elb_code",
                       "tgt_code", "client_ip", "client_port", "target", "req_t", "tgt_t", "rx", "tx", "user_agent",
                       "trace_id", "actions", "error_reason", "rule_priority", "ssl_protocol")


@QUERIES.add("access_keys", sql("""
    SELECT l_orderkey, l_linenumber, '111122223333' AS account, 'us-west-2' AS region, 'elb-' || l_suppkey % 4 AS lb,
           epoch_ms(l_shipdate) + l_partkey % 1440 * 60000 AS end_ms,
           (epoch_ms(l_shipdate) + l_partkey % 1440 * 60000 - 60000) // 3600000 * 3600000 AS hour_ms
    FROM lineitem WHERE l_partkey % 10 <> 0"""))
def access_keys(spark, sf_dir):
    """File names rendered from line items; a tenth of them are no access log files."""
    end = F.timestamp_millis(F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_partkey") % 1440 * 60_000)
    name = F.concat(F.lit("logs/2026/111122223333_elasticloadbalancing_us-west-2_app.elb-"),
                    (F.col("l_suppkey") % 4).cast("string"), F.lit(".1a2b_"), F.date_format(end, "yyyyMMdd'T'HHmm'Z'"),
                    F.lit("_10.0.0.1_ab"), F.when(F.col("l_partkey") % 10 == 0, ".txt").otherwise(".log.gz"))
    files = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("path"))
    return access.parse_access_key(files).drop("path")


# ---- roll-ups
@QUERIES.add("rollup_minute", sql("""SELECT minute_ms, lb, tg, cluster, domain, elb_code, tgt_code, CAST(lat_bin AS TINYINT) AS lat_bin,
    count(*) AS n, round(sum(tgt_t), 6) AS tgt_t_sum, count(tgt_t) AS tgt_t_n FROM v_bins GROUP BY ALL"""))
def rollup_minute(spark, sf_dir):
    rollup = access.minute_rollup(views.requests(spark, sf_dir))
    return rollup.withColumn("tgt_t_sum", F.round("tgt_t_sum", ROUND))


@QUERIES.add("rollup_paths", sql("""SELECT minute_ms, lb, tg, cluster, method, path_group, elb_code, tgt_code,
    CAST(lat_bin AS TINYINT) AS lat_bin, count(*) AS n, round(sum(tgt_t), 6) AS tgt_t_sum, count(tgt_t) AS tgt_t_n
    FROM v_bins GROUP BY ALL"""))
def rollup_paths(spark, sf_dir):
    rollup = access.path_rollup(views.requests(spark, sf_dir))
    return rollup.withColumn("tgt_t_sum", F.round("tgt_t_sum", ROUND))


for _name, _step in (("hours", HOUR), ("days", DAY)):
    @QUERIES.add(f"rollup_{_name}", sql(f"""SELECT minute_ms // {_step} * {_step} AS minute_ms, lb, tg, cluster, domain, elb_code, tgt_code,
        CAST(lat_bin AS TINYINT) AS lat_bin, count(*) AS n, round(sum(tgt_t), 6) AS tgt_t_sum, count(tgt_t) AS tgt_t_n FROM v_bins GROUP BY ALL"""))
    def rollup_long(spark, sf_dir, step=_step):
        rollup = access.coarser(access.minute_rollup(views.requests(spark, sf_dir)), step)
        return rollup.withColumn("tgt_t_sum", F.round("tgt_t_sum", ROUND))


_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@QUERIES.add("latency_percentiles", sql(f"""WITH q AS ({percentile_sql('v_bins', 'lb, domain', _QUANTILES)})
    SELECT lb, domain, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM q"""))
def latency_percentiles(spark, sf_dir):
    rollup = access.minute_rollup(views.requests(spark, sf_dir))
    found = lb.bin_percentiles(rollup, ["lb", "domain"], _QUANTILES)
    return found.select("lb", "domain", *[F.round(q, ROUND).alias(q) for q in _QUANTILES])


# ---- the summary page
_CLASSES = ", ".join(f"count(*) FILTER (elb_code BETWEEN {c[0]}00 AND {c[0]}99) AS c{c}" for c in P.STATUS_CLASSES)
_OTHER = "count(*) FILTER (elb_code IS NULL OR elb_code < 200 OR elb_code >= 600) AS other"
_BLAME = ("count(*) FILTER (elb_code >= 500 AND tgt_code IS NOT NULL) AS s5xx_app, "
          "count(*) FILTER (elb_code >= 500 AND tgt_code IS NULL) AS s5xx_lb")
_AVG = "round(sum(tgt_t) / nullif(count(tgt_t), 0), 6) AS avg"


_TOTALS = sql(f"""WITH m AS (SELECT * FROM v_bins WHERE {ROLLED}),
    q AS ({percentile_sql('m', '', _QUANTILES)})
    SELECT count(*) AS requests, {_CLASSES}, {_OTHER}, {_BLAME}, {_AVG},
           (SELECT round(p50, 6) FROM q) AS p50, (SELECT round(p95, 6) FROM q) AS p95, (SELECT round(p99, 6) FROM q) AS p99
    FROM m""")


@QUERIES.add("lb_totals", _TOTALS)
def lb_totals(spark, sf_dir):
    totals = lb.status_totals(_query().minutes(tables(spark, sf_dir)))
    return totals.withColumns({c: F.round(c, ROUND) for c in ("avg", "p50", "p95", "p99")})


@QUERIES.add("lb_totals_long", _TOTALS)
def lb_totals_long(spark, sf_dir):
    """The same from minutes, hours and days, where there are some."""
    totals = lb.status_totals(_query().minutes(long_tables(spark, sf_dir), None))
    return totals.withColumns({c: F.round(c, ROUND) for c in ("avg", "p50", "p95", "p99")})


@QUERIES.add("lb_buckets_long", sql(f"""SELECT minute_ms // {3 * HOUR} * {3 * HOUR} AS t, {_CLASSES}, {_OTHER} FROM v_bins
    WHERE {ROLLED} AND domain = 'd1.example.com' GROUP BY 1"""))
def lb_buckets_long(spark, sf_dir):
    return lb.status_buckets(_query(domains=["d1.example.com"]).minutes(long_tables(spark, sf_dir), 3 * HOUR), 3 * HOUR)


@QUERIES.add("lb_buckets", sql(f"""SELECT minute_ms // {12 * HOUR} * {12 * HOUR} AS t, {_CLASSES}, {_OTHER} FROM v_bins
    WHERE {ROLLED} AND domain = 'd1.example.com' GROUP BY 1"""))
def lb_buckets(spark, sf_dir):
    return lb.status_buckets(_query(domains=["d1.example.com"]).minutes(tables(spark, sf_dir)), 12 * HOUR)


#: worst: per target group, the path that no other of it beats in errors (then by name), with its most frequent error code
_TOP_ERROR = """
    failing AS (SELECT tg, method, path_group, elb_code, count(*) AS times FROM m WHERE elb_code >= 400 GROUP BY ALL),
    of_path AS (SELECT tg, method, path_group, CAST(sum(times) AS BIGINT) AS errors, max({'times': times, 'code': elb_code}).code AS code FROM failing GROUP BY ALL),
    worst AS (SELECT tg, list(p ORDER BY p.errors DESC, p.path_group, p.method)[1] AS p
              FROM (SELECT tg, {'errors': errors, 'path_group': path_group, 'method': method, 'code': code} AS p FROM of_path) GROUP BY tg)"""


@QUERIES.add("lb_target_groups", sql(f"""WITH m AS (SELECT * FROM v_bins WHERE {ROLLED}), {_TOP_ERROR},
    q AS ({percentile_sql('m', 'tg', {'p95': 0.95})}),
    g AS (SELECT tg, min(cluster) AS cluster, string_agg(DISTINCT lb, ',' ORDER BY lb) AS lbs, count(*) AS requests,
                 count(*) FILTER (elb_code BETWEEN 400 AND 499) AS s4xx, {_BLAME}, {_AVG} FROM m GROUP BY tg)
    SELECT g.*, s5xx_app + s5xx_lb AS s5xx, round(q.p95, 6) AS p95, w.p.method AS error_method, w.p.path_group AS error_path,
           w.p.code AS error_code, w.p.errors AS error_count
    FROM g LEFT JOIN q ON q.tg IS NOT DISTINCT FROM g.tg LEFT JOIN worst w ON w.tg IS NOT DISTINCT FROM g.tg"""))
def lb_target_groups(spark, sf_dir):
    t, q = tables(spark, sf_dir), _query()
    rows = lb.target_group_table(q.minutes(t), q.paths(t))
    return rows.withColumns({"lbs": F.array_join("lbs", ","), "avg": F.round("avg", ROUND),
                             "p95": F.round("p95", ROUND)})


@QUERIES.add("lb_top_error", sql(f"""WITH m AS (SELECT * FROM v_bins WHERE {ROLLED} AND lb = 'lb-1'), {_TOP_ERROR}
    SELECT tg, p.method AS error_method, p.path_group AS error_path, p.code AS error_code, p.errors AS error_count FROM worst"""))
def lb_top_error(spark, sf_dir):
    return lb.top_error_paths(_query(lbs=["lb-1"]).paths(tables(spark, sf_dir)))


@QUERIES.add("lb_codes", sql(f"""SELECT elb_code, count(*) AS n, count(*) FILTER (tgt_code IS NOT NULL) AS app FROM v_bins
    WHERE {ROLLED} AND tg = 'tg-c1' AND elb_code IS NOT NULL GROUP BY elb_code"""))
def lb_codes(spark, sf_dir):
    return lb.code_counts(_query(target_groups=["tg-c1"]).minutes(tables(spark, sf_dir)))


@QUERIES.add("lb_path_codes", sql(f"""SELECT tg, method, path_group, elb_code, count(*) AS n FROM v_bins
    WHERE {ROLLED} AND tg IS NOT NULL GROUP BY ALL"""))
def lb_path_codes(spark, sf_dir):
    return lb.path_code_counts(_query().paths(tables(spark, sf_dir)))


def _paths_sql(order: str, limit: int) -> str:
    return sql(f"""WITH m AS (SELECT * FROM v_bins WHERE {ROLLED}),
    q AS ({percentile_sql('m', 'method, path_group', {'p95': 0.95})}),
    totals AS (SELECT method, path_group, count(*) AS requests, {_CLASSES}, count(*) FILTER (elb_code >= 500) AS s5xx,
                      count(*) FILTER (elb_code BETWEEN 400 AND 499) AS s4xx, {_AVG} FROM m GROUP BY ALL),
    owners AS (SELECT method, path_group, string_agg(tg, ',' ORDER BY tg) AS tgs
               FROM (SELECT *, row_number() OVER (PARTITION BY method, path_group ORDER BY tg) AS place
                     FROM (SELECT DISTINCT method, path_group, tg FROM m WHERE tg IS NOT NULL)) WHERE place <= 3 GROUP BY ALL),
    frequent AS (SELECT method, path_group, max({{'times': times, 'code': elb_code}}).code AS top_code
                 FROM (SELECT method, path_group, elb_code, count(*) AS times FROM m WHERE elb_code IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT totals.*, coalesce(tgs, '') AS tgs, top_code, (SELECT count(*) FROM totals) AS groups, round(q.p95, 6) AS p95
    FROM totals LEFT JOIN q USING (method, path_group) LEFT JOIN owners USING (method, path_group) LEFT JOIN frequent USING (method, path_group)
    ORDER BY {order}, path_group, method LIMIT {limit}""")


def _paths(sort: str, limit: int, long: bool = False):
    def run(spark, sf_dir):
        paths = _query().paths(long_tables(spark, sf_dir), None) if long else _query().paths(tables(spark, sf_dir))
        rows = lb.path_table(paths, sort, limit)
        return rows.withColumns({"tgs": F.array_join("tgs", ","), "avg": F.round("avg", ROUND),
                                 "p95": F.round("p95", ROUND)})
    return run


for _sort, _order in [("errors", "s5xx DESC, s4xx DESC, requests DESC"), ("requests", "requests DESC"),
                      ("slow", "p95 DESC NULLS LAST, requests DESC")]:
    QUERIES.add(f"lb_paths_{_sort}", _paths_sql(_order, 5))(_paths(_sort, 5))
QUERIES.add("lb_paths_long", _paths_sql("s5xx DESC, s4xx DESC, requests DESC", 50))(_paths("errors", 50, True))


@QUERIES.add("lb_overview", sql(f"""SELECT lb, tg, min(cluster) AS cluster, count(*) AS requests FROM v_bins
    WHERE minute_ms BETWEEN {1704067200000 + 9 * DAY} AND {1704067200000 + 10 * DAY} AND cluster IN ('c1', 'c2') GROUP BY lb, tg"""))
def lb_overview(spark, sf_dir):
    """The last 24 hours before a given now, for a member who sees two clusters."""
    now = 1704067200000 + 10 * DAY
    query = RequestQuery(now - DAY, now, access=Access({"c1": "view", "c2": "view", "c3": "none"}))
    return lb.overview(query.minutes(tables(spark, sf_dir)))


# ---- filters
def _filtered(name: str, where: str, rows: bool = False, **filters) -> None:
    """Totals per balancer of a filter, from whichever table it is routed to."""
    timed = TIMED if rows else ROLLED

    @QUERIES.add(f"lb_filter_{name}", sql(f"SELECT lb, count(*) AS n FROM v_bins WHERE {timed} AND {where} GROUP BY lb"))
    def run(spark, sf_dir):
        query = _query(**filters)
        assert (query.level() == lb.ROWS) == rows
        return query.minutes(tables(spark, sf_dir)).groupBy("lb").agg(F.sum("n").alias("n"))


_filtered("class", "elb_code // 100 IN (4, 5)", status_classes=["4xx", "5xx"])
_filtered("other", "(elb_code IS NULL OR elb_code < 200 OR elb_code >= 600 OR elb_code // 100 = 3)",
          status_classes=["other", "3xx"])
_filtered("code", "elb_code IN (404, 502)", status_codes=[404, 502])
_filtered("source_app", "tgt_code IS NOT NULL AND elb_code >= 500", source="app", status_classes=["5xx"])
_filtered("source_lb", "tgt_code IS NULL", source="lb")
_filtered("group_null", "(tg IN ('tg-c3') OR tg IS NULL)", target_groups=["tg-c3", "-"])
_filtered("domain", "domain = 'd0.example.com'", domains=["d0.example.com"])
_filtered("method", "method IN ('PUT', 'POST')", methods=["put", "POST"])
_filtered("path_group", "path_group = '/api/v1/<store>/error/<n>'", path_group="/api/v1/<store>/error/<n>")
_filtered("method_domain", "method = 'GET' AND domain = 'd0.example.com'", True, methods=["GET"],
          domains=["d0.example.com"])
_filtered("path", "lower(path) LIKE '%s3.myshopify.com/er%'", True, path="S3.myshopify.com/er")
_filtered("path_wildcard", "lower(path) LIKE '/api/%/purchase/%7'", True, path="/api/*/purchase/*7")
_filtered("client", "client_ip LIKE '10.0.1%'", True, client="10.0.1")
_filtered("target", "target LIKE '10.1.0.1%:80%'", True, target="10.1.0.1*:80")
_filtered("slow", "tgt_t >= 0.5", True, min_target_seconds=0.5)
_filtered("words", "lower(raw) LIKE '%s1.myshopify%' AND NOT lower(raw) LIKE '%post https%' AND lower(raw) LIKE '%tg-c%root=%9%'",
          True, words='s1.myshopify -"POST https" TG-c*Root=*9')


@QUERIES.add("lb_access_star", sql(f"""SELECT cluster, count(*) AS n FROM v_bins WHERE {ROLLED} AND cluster IS NOT NULL
    AND cluster NOT IN ('c2', 'c5') GROUP BY cluster"""))
def lb_access_star(spark, sf_dir):
    query = _query(access=Access({"*": "view", "c2": "none", "c5": "none", "c1": "view"}))
    return query.minutes(tables(spark, sf_dir)).groupBy("cluster").agg(F.sum("n").alias("n"))


# ---- single requests
_ROW = "ts_ms, lb, tg, method, path, elb_code, round(tgt_t, 6) AS tgt_t, trace_id"


def _rows(df):
    return df.select("ts_ms", "lb", "tg", "method", "path", "elb_code", F.round("tgt_t", ROUND).alias("tgt_t"), "trace_id")


@QUERIES.add("lb_requests_page", sql(f"SELECT {_ROW} FROM v_req WHERE {TIMED} AND elb_code // 100 = 5 "
                                     "ORDER BY v_req.ts_ms DESC, v_req.trace_id LIMIT 100 OFFSET 250"))
def lb_requests_page(spark, sf_dir):
    return _rows(lb.request_page(_query(status_classes=["5xx"]), tables(spark, sf_dir), 100, 250))


@QUERIES.add("lb_requests_page_oldest", sql(f"SELECT {_ROW} FROM v_req WHERE {TIMED} AND lower(raw) LIKE '%click%' "
                                            "ORDER BY v_req.ts_ms, v_req.trace_id LIMIT 50 OFFSET 30"))
def lb_requests_page_oldest(spark, sf_dir):
    return _rows(lb.request_page(_query(words="click"), tables(spark, sf_dir), 50, 30, descending=False))


@QUERIES.add("lb_page_hours", sql(f"""SELECT * FROM (
    SELECT hour_ms, n, CAST(sum(n) OVER (ORDER BY hour_ms DESC) AS BIGINT) AS upto,
           CAST(sum(n) OVER (ORDER BY hour_ms DESC) - n AS BIGINT) AS before
    FROM (SELECT ts_ms // {HOUR} * {HOUR} AS hour_ms, count(*) AS n FROM v_req WHERE {TIMED} GROUP BY 1))
    WHERE upto > 250 AND before < 350"""))
def lb_page_hours(spark, sf_dir):
    return lb.page_hours(lb.hour_counts(_query(), tables(spark, sf_dir)), 250, 100)


@QUERIES.add("lb_slowest", sql(f"SELECT {_ROW} FROM v_req WHERE {TIMED} AND tgt_t IS NOT NULL "
                               "ORDER BY v_req.tgt_t DESC, v_req.ts_ms DESC, v_req.trace_id LIMIT 20"))
def lb_slowest(spark, sf_dir):
    return _rows(lb.slowest(_query(), tables(spark, sf_dir), 20))


for _name, _filter, _where in [("words", {"words": "/77"}, "raw ILIKE '%/77%'"), ("method", {"methods": ["PUT"]}, "method = 'PUT'"),
                               ("path", {"path": "/api/v1/*"}, "path ILIKE '/api/v1/%'")]:
    @QUERIES.add(f"lb_slowest_{_name}", sql(f"SELECT {_ROW} FROM v_req WHERE {TIMED} AND tgt_t IS NOT NULL AND v_req.{_where} "
                                            "ORDER BY v_req.tgt_t DESC, v_req.ts_ms DESC, v_req.trace_id LIMIT 20"))
    def _slowest(spark, sf_dir, _filter=_filter):
        return _rows(lb.slowest(_query(**_filter), tables(spark, sf_dir), 20))


@QUERIES.add("lb_unmerged_totals", sql(f"""SELECT count(*) AS requests, {_CLASSES}, {_OTHER}, {_BLAME}, {_AVG}
    FROM v_bins WHERE {ROLLED}"""))
def lb_unmerged_totals(spark, sf_dir):
    """Finished hours from their roll-up, the newest hours from rows not merged yet."""
    requests, cut = views.requests(spark, sf_dir), START // HOUR * HOUR + 20 * DAY
    done, fresh = requests.filter(F.col("ts_ms") < cut), requests.filter(F.col("ts_ms") >= cut)
    both = RequestTables(done, access.minute_rollup(done), access.path_rollup(done), fresh)
    query = RequestQuery(FIRST_MINUTE, END)
    totals = lb.status_totals(query.minutes(both)).drop("p50", "p95", "p99")
    return totals.withColumn("avg", F.round("avg", ROUND))
