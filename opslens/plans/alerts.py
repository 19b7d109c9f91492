"""Alert rules, mutes, alert state and access."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR, MINUTE
from ..operators import access, grants, lb, rules, state
from ..operators.mutes import Mute, muted_paths, muted_signatures
from . import views
from .logs import EXCEPTION_SQL, TEMPLATES_SQL, kinds_sql
from .oracle import percentile_sql, sql
from .registry import Registry

QUERIES = Registry()

T0 = 1704067200000
NOW = T0 + 20 * DAY
WINDOW = 3 * 24 * 60                       # minutes
END = NOW - 10 * MINUTE
START = END - WINDOW * MINUTE
_NOW_T = f"minute_ms BETWEEN {START // MINUTE * MINUTE} AND {END}"
_DAY_T = f"minute_ms BETWEEN {(START - DAY) // MINUTE * MINUTE} AND {START}"


def _minutes(spark, sf_dir):
    return access.minute_rollup(views.requests(spark, sf_dir))


def _paths(spark, sf_dir):
    window = lb.RequestQuery(START, END)
    return lb.path_code_counts(access.path_rollup(views.requests(spark, sf_dir)).filter(window.condition(lb.PATHS)))


def _shape(found):
    """The columns the SQL twins write."""
    return rules.with_level(found).select("subject", "bad", F.round("value", 4).alias("value"), "level_now", "warning",
                                          "critical", "cluster", F.array_join("muted_by", ",").alias("muted_by"),
                                          "muted_level")


def _rates(hit: str, hit_now: str | None = None) -> str:
    return f"""r AS (SELECT tg, min(cluster) AS cluster, count(*) FILTER ({_NOW_T} AND {hit_now or hit}) AS n,
        count(*) FILTER ({_NOW_T}) AS total, 100.0::DOUBLE * count(*) FILTER ({_DAY_T} AND {hit}) / nullif(count(*) FILTER ({_DAY_T}), 0) AS usual
        FROM v_bins WHERE tg IS NOT NULL GROUP BY tg HAVING count(*) FILTER ({_NOW_T}) > 0)"""


def _lb_sql(rates: str, share: str, watch: str, value: str, warning: float, critical: float, extra: str = "",
            muted: str = "''", ids_join: str = "", n: str = "n", total: str = "total") -> str:
    """Findings of a balancer rule; ``watch`` is a test over n, total, usual and pct."""
    return sql(f"""WITH {rates}{extra}, p AS (SELECT *, {n} AS n2, {total} AS total2 FROM r {ids_join}),
      s AS (SELECT *, {share.format(n='n', total='total')} AS pct0, {share.format(n='n2', total='total2')} AS pct FROM p),
      w AS (SELECT *, coalesce({watch.format(n='n2', total='total2', pct='pct')}, false) AS watch,
                   coalesce({watch.format(n='n', total='total', pct='pct0')}, false) AS watch0 FROM s),
      v AS (SELECT *, {value.format(n='n2', pct='pct')} AS value, {value.format(n='n', pct='pct0')} AS value0 FROM w),
      b AS (SELECT *, watch AND value >= {warning} AS bad1, watch0 AND value0 >= {warning} AS bad0 FROM v),
      m AS (SELECT *, {muted} AS ids FROM b)
      SELECT tg AS subject, bad1 AND ids = '' AS bad, round(CAST(value AS DOUBLE), 4) AS value,
             CASE WHEN bad1 AND ids = '' THEN CASE WHEN value >= {critical} THEN 'critical' ELSE 'warning' END END AS level_now,
             CASE WHEN watch AND ids = '' THEN CAST({warning} AS DOUBLE) END AS warning,
             CASE WHEN watch AND ids = '' THEN CAST({critical} AS DOUBLE) END AS critical, cluster, ids AS muted_by,
             CASE WHEN ids <> '' THEN CASE WHEN value0 >= {critical} THEN 'critical' ELSE 'warning' END END AS muted_level FROM m""")


_SHARE = "(100.0::DOUBLE * {n} / nullif({total}, 0))"


@QUERIES.add("alert_rate", _lb_sql(_rates("elb_code BETWEEN 500 AND 599", "elb_code >= 500"), _SHARE,
                                   "{total} >= 60 AND {pct} > 18 - 2", "coalesce(round({pct}, 2), 0)", 18, 22))
def alert_rate(spark, sf_dir):
    return _shape(rules.lb_errors(_minutes(spark, sf_dir), "r1", NOW, WINDOW, 18, 22, min_requests=60))


@QUERIES.add("alert_usual", _lb_sql(_rates("elb_code BETWEEN 400 AND 499"), _SHARE,
                                    "{total} >= 10 AND {pct} > 2 - 0.4 AND (usual IS NULL OR (usual = 0 AND {pct} > 0) OR {pct} >= usual * 1.5)",
                                    "coalesce(round({pct}, 2), 0)", 2, 4))
def alert_usual(spark, sf_dir):
    """Client errors, only where they are unusual for the target group."""
    return _shape(rules.lb_errors(_minutes(spark, sf_dir), "r2", NOW, WINDOW, 2, None, "4xx", 10, vs_usual=1.5))


@QUERIES.add("alert_status_codes", _lb_sql(_rates("(elb_code // 100 = 5 OR elb_code IN (404))"),
                                           "coalesce(100.0::DOUBLE * {n} / nullif({total}, 0), 0)", "{n} > 20 - 2 AND {pct} >= 15",
                                           "{n}", 20, 30))
def alert_status_codes(spark, sf_dir):
    """A class, a code of it (counted once) and another code."""
    return _shape(rules.lb_status(_minutes(spark, sf_dir), "r3", NOW, WINDOW, ["5xx", "503", "404"], 20, 30, 15))


@QUERIES.add("alert_latency", sql(f"""WITH m AS (SELECT * FROM v_bins WHERE {_NOW_T}), q AS ({percentile_sql('m', 'tg', {'p95': 0.95})}),
    g AS (SELECT tg, min(cluster) AS cluster, count(*) AS requests FROM m GROUP BY tg)
    SELECT tg AS subject, requests >= 50 AND p95 * 1000 >= 1500 AS bad, round_even(p95 * 1000, 0) AS value, cluster
    FROM g JOIN q USING (tg) WHERE tg IS NOT NULL AND p95 IS NOT NULL"""))
def alert_latency(spark, sf_dir):
    return rules.lb_latency(_minutes(spark, sf_dir), "r4", NOW, WINDOW, 1500).select("subject", "bad", "value", "cluster")


# ---- mutes
PATH_MUTES = [
    Mute("P1", target_groups=["tg-c[13]"], paths=[(None, "/api/v1/<store>/error/*")], codes=["5xx"]),
    Mute("P2", clusters=["C*"], paths=[("POST", "/api/v?/<store>/error/<n>")], rules=["lb_errors"]),
    Mute("P3", paths=[("PUT", "*")], codes=["4xx"]),
]
_OWNER = """CASE WHEN tg IN ('tg-c1', 'tg-c3') AND path_group LIKE '/api/v1/%/error/%' AND elb_code // 100 = 5 THEN 'P1'
                 WHEN method = 'POST' AND path_group = '/api/v1/<store>/error/<n>' THEN 'P2' END"""
_MUTED = f"""d AS (SELECT tg, count(*) FILTER (elb_code >= 500) AS dn, count(*) AS dt, string_agg(DISTINCT mid, ',' ORDER BY mid) AS mids
    FROM (SELECT *, {_OWNER} AS mid FROM v_bins WHERE {_NOW_T} AND tg IS NOT NULL) WHERE mid IS NOT NULL GROUP BY tg)"""


@QUERIES.add("mute_paths", sql(f"WITH {_MUTED} SELECT tg, dn AS muted_n, dt AS muted_total, mids AS path_ids FROM d"))
def mute_paths(spark, sf_dir):
    """What muted paths take out per target group; the first entry that fits a row has it."""
    rows = muted_paths(_paths(spark, sf_dir), PATH_MUTES, "lb_errors", ["5xx"])
    return rows.withColumn("path_ids", F.array_join("path_ids", ","))


@QUERIES.add("alert_rate_muted", _lb_sql(
    _rates("elb_code BETWEEN 500 AND 599", "elb_code >= 500"), _SHARE, "{total} >= 60 AND {pct} > 18 - 2 AND (100.0::DOUBLE * n / total) > 16",
    "coalesce(round({pct}, 2), 0)", 18, 22, f", {_MUTED}", "CASE WHEN bad0 AND NOT bad1 THEN coalesce(mids, '') ELSE '' END",
    "LEFT JOIN d USING (tg)", "greatest(0, n - CASE WHEN total >= 60 AND 100.0::DOUBLE * n / total > 16 THEN coalesce(dn, 0) ELSE 0 END)",
    "greatest(0, total - CASE WHEN total >= 60 AND 100.0::DOUBLE * n / total > 16 THEN coalesce(dt, 0) ELSE 0 END)"))
def alert_rate_muted(spark, sf_dir):
    """The error rate judged again without the requests on muted paths."""
    return _shape(rules.lb_errors(_minutes(spark, sf_dir), "r1", NOW, WINDOW, 18, 22, min_requests=60, mutes=PATH_MUTES,
                                  path_counts=_paths(spark, sf_dir)))


SIGNATURES = [Mute("S1", clusters=["c0", "c1", "c2"], signatures=['"k": 1', '"k": 2', '"k": 3', '"k": 4', '"k": 5']),
              Mute("S2", target_groups=["tg-c1"], signatures=['"k": 6', '"k": 7', '"k": 8', '"k": 9', '"k": 0'])]
_HIT1 = "(" + " OR ".join(f"contains(msg, '\"k\": {i}')" for i in range(1, 6)) + ")"
_HIT2 = "(" + " OR ".join(f"contains(msg, '\"k\": {i}')" for i in (6, 7, 8, 9, 0)) + ")"


@QUERIES.add("mute_signature", sql(f"""WITH l AS (SELECT cluster, {_HIT1} AS h1, {_HIT2} AS h2 FROM v_logs WHERE level = 'ERROR' AND
      log_time_ms BETWEEN {START - 2 * MINUTE} AND {END + 2 * MINUTE}),
    g AS (SELECT DISTINCT tg, cluster FROM v_bins WHERE {_NOW_T} AND tg IN ('tg-c0', 'tg-c1', 'tg-c2'))
    SELECT tg, CASE WHEN bool_or(h1) THEN 'S1' ELSE '' END || CASE WHEN bool_or(h1) AND bool_or(h2) AND tg = 'tg-c1' THEN ',' ELSE '' END ||
           CASE WHEN bool_or(h2) AND tg = 'tg-c1' THEN 'S2' ELSE '' END AS signature_ids
    FROM g JOIN l USING (cluster) GROUP BY tg HAVING bool_and(h1 OR (h2 AND tg = 'tg-c1'))"""))
def mute_signature(spark, sf_dir):
    """Target groups whose own error lines in the window are all muted errors."""
    lines = views.logs(spark, sf_dir).filter("level = 'ERROR'")
    rows = muted_signatures(_paths(spark, sf_dir), lines, SIGNATURES, "lb_errors", ["5xx"], START, END)
    return rows.withColumn("signature_ids", F.array_join("signature_ids", ","))


# ---- logs
LOG_MUTES = [Mute("L1", clusters=["c1"], signatures=["user 1", "user 4"]), Mute("L2", target_groups=["tg-c2"], signatures=["error user"])]


@QUERIES.add("alert_log_errors", sql(f"""WITH n AS (SELECT cluster, count(*) AS n0, count(*) FILTER (NOT (
      (cluster = 'c1' AND (contains(msg, 'user 1') OR contains(msg, 'user 4'))) OR (cluster = 'c2' AND contains(msg, 'error user')))) AS n
      FROM v_logs WHERE level = 'ERROR' AND log_time_ms BETWEEN {NOW - WINDOW * MINUTE} AND {NOW} GROUP BY cluster)
    SELECT cluster AS subject, n >= 20 AS bad, CAST(n AS DOUBLE) AS value, cluster,
           CASE WHEN n0 >= 20 AND n < 20 THEN CASE cluster WHEN 'c1' THEN 'L1' WHEN 'c2' THEN 'L2' ELSE '' END ELSE '' END AS muted_by FROM n"""))
def alert_log_errors(spark, sf_dir):
    rows = rules.log_errors(views.logs(spark, sf_dir), "r5", NOW, WINDOW, 20, mutes=LOG_MUTES)
    return rows.select("subject", "bad", "value", "cluster", F.array_join("muted_by", ",").alias("muted_by"))


_STALE_NOW = T0 + 25 * DAY + 90 * MINUTE


@QUERIES.add("alert_logs_stale", sql(f"""WITH f AS (SELECT cluster, log_time_ms // {HOUR} * {HOUR} AS hour_ms,
        max(CASE WHEN row_id % 2 = 0 THEN log_time_ms // 1000 * 1000 END) AS stamp FROM v_logs
      WHERE log_time_ms // {HOUR} * {HOUR} BETWEEN {_STALE_NOW // HOUR * HOUR - 3 * HOUR} AND {_STALE_NOW // HOUR * HOUR} GROUP BY ALL),
    n AS (SELECT cluster, arg_max(coalesce(stamp, hour_ms + {HOUR} - 1), hour_ms) AS newest FROM f GROUP BY cluster)
    SELECT c.cluster AS subject, newest IS NULL OR ({_STALE_NOW} - newest) / 60000 >= 70 AS bad,
           round_even(({_STALE_NOW} - newest) / 60000, 0) AS value FROM (SELECT DISTINCT cluster FROM v_logs) c LEFT JOIN n USING (cluster)"""))
def alert_logs_stale(spark, sf_dir):
    """File names rendered from log lines: half of them start with an epoch."""
    logs = views.logs(spark, sf_dir)
    files = logs.selectExpr("cluster", f"log_time_ms - pmod(log_time_ms, {HOUR}) AS hour_ms",
                            "IF(row_id % 2 = 0, CAST(log_time_ms DIV 1000 AS STRING), 'part') || '-x.parquet' AS name")
    return rules.logs_stale(logs, files, "r6", _STALE_NOW, 70).select("subject", "bad", "value")


@QUERIES.add("alert_lb_logs_stale", sql(f"""SELECT lb AS subject, ({T0 + 30 * DAY} - max(ts_ms)) / 60000 >= 10 AS bad,
    round_even(({T0 + 30 * DAY} - max(ts_ms)) / 60000, 0) AS value FROM v_req GROUP BY lb
    UNION ALL SELECT 'All load balancers', ({T0 + 30 * DAY} - max(ts_ms)) / 60000 >= 10, round_even(({T0 + 30 * DAY} - max(ts_ms)) / 60000, 0) FROM v_req"""))
def alert_lb_logs_stale(spark, sf_dir):
    latest = views.requests(spark, sf_dir).groupBy("lb").agg(F.max("ts_ms").alias("end_ms"))
    parts = [rules.lb_logs_stale(latest, "r7", T0 + 30 * DAY, 10, each) for each in (True, False)]
    return parts[0].unionByName(parts[1]).select("subject", "bad", "value")


# ---- services
HEALTH_MUTES = [Mute("H1", clusters=["c1*"], health_reasons=["Target.Failed*"]), Mute("H2", target_groups=["tg-c2?"], health_reasons=["draining"])]


@QUERIES.add("alert_targets", sql("""WITH t AS (SELECT l.cluster, l.tg, t.state, t.state IN ('unhealthy', 'draining', 'unavailable', 'initial') AS is_bad,
      CASE WHEN t.state = 'unhealthy' AND reason IS NOT NULL AND l.cluster LIKE 'c1%' THEN 'H1'
           WHEN t.state = 'draining' AND length(l.cluster) = 3 AND l.cluster LIKE 'c2%' THEN 'H2' END AS mid
      FROM v_link l JOIN v_target t USING (tg)),
    g AS (SELECT cluster, tg, count(*) AS total, count(*) FILTER (state = 'healthy') AS healthy, count(*) FILTER (is_bad) AS bad0,
                 count(*) FILTER (is_bad AND mid IS NULL) AS bad FROM t GROUP BY ALL),
    i AS (SELECT cluster, string_agg(DISTINCT mid, ',' ORDER BY mid) AS ids FROM t WHERE mid IS NOT NULL GROUP BY cluster),
    c AS (SELECT cluster, CAST(sum(bad0) AS BIGINT) AS bad0, CAST(sum(bad) AS BIGINT) AS bad, bool_or(healthy = 0) AS empty0,
                 bool_or(healthy = 0 AND (bad > 0 OR bad0 = 0)) AS empty FROM g GROUP BY cluster)
    SELECT cluster AS subject, empty OR bad >= 5 AS bad, CAST(bad AS DOUBLE) AS value, CASE WHEN empty THEN 'critical' ELSE 'warning' END AS level,
           CASE WHEN (empty0 OR bad0 >= 5) AND NOT (empty OR bad >= 5) THEN coalesce(ids, '') ELSE '' END AS muted_by
    FROM c LEFT JOIN i USING (cluster)"""))
def alert_targets(spark, sf_dir):
    rows = rules.ecs_targets(views.inventory(spark, sf_dir), "r8", NOW, 5, HEALTH_MUTES)
    return rows.select("subject", "bad", "value", "level", F.array_join("muted_by", ",").alias("muted_by"))


@QUERIES.add("alert_tasks", sql("""SELECT cluster || ' / ' || service AS subject, running < desired AS bad, CAST(running AS DOUBLE) AS value,
    CASE WHEN running = 0 THEN 'critical' ELSE 'warning' END AS level,
    CAST(CASE WHEN running < desired AND running > 0 AND rollout = 'IN_PROGRESS' THEN 10 ELSE 0 END AS INTEGER) AS hold FROM v_service WHERE desired > 0"""))
def alert_tasks(spark, sf_dir):
    rows = rules.ecs_tasks(views.inventory(spark, sf_dir)["services"], "r9", NOW)
    return rows.select("subject", "bad", "value", "level", "hold")


@QUERIES.add("alert_usage", sql(f"""SELECT cluster AS subject, avg >= warning AS bad, round(avg, 1) AS value, warning FROM (
    SELECT cluster, avg(value) AS avg, CASE WHEN cluster = 'c1' THEN 4.0::DOUBLE ELSE 70.0 END AS warning FROM v_util
    WHERE t_ms >= {NOW - 720 * MINUTE} GROUP BY cluster)"""))
def alert_usage(spark, sf_dir):
    rows = rules.ecs_usage(views.utilisation(spark, sf_dir), "r10", NOW, 720, "cpu", {"c1": {"warning": 4, "critical": 9}})
    return rows.select("subject", "bad", "value", "warning")


#: an order month stands for a check five hours after the one before
_CHECK = f"CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) * {5 * HOUR}"
_HERE = f"((at_ms // {5 * HOUR} + l_suppkey) % 11 < 5 OR q % 5 = 0)"
_SHORT = f"at_ms // {15 * HOUR} % 3 <> 0"


@QUERIES.add("alert_instances", f"""WITH i AS (SELECT l_suppkey, {_CHECK} AS at_ms, l_quantity FROM lineitem),
    checks AS (SELECT DISTINCT l_suppkey % 5 AS c, at_ms, {_SHORT} AS short FROM i),
    seen AS (SELECT l_suppkey, at_ms FROM (SELECT l_suppkey, at_ms, sum(l_quantity) AS q FROM i GROUP BY ALL) WHERE {_HERE}),
    some_there AS (SELECT l_suppkey % 5 AS c, at_ms, count(*) AS there FROM seen GROUP BY ALL),
    alarms AS (SELECT c, at_ms, short OR there IS NULL AS alarming FROM checks LEFT JOIN some_there USING (c, at_ms)),
    pairs AS (SELECT s.l_suppkey, a.at_ms, alarming, n.at_ms IS NOT NULL AS here
              FROM (SELECT DISTINCT l_suppkey FROM seen) s JOIN alarms a ON a.c = s.l_suppkey % 5
              LEFT JOIN seen n ON n.l_suppkey = s.l_suppkey AND n.at_ms = a.at_ms),
    since AS (SELECT *, max(CASE WHEN here THEN at_ms END) OVER (PARTITION BY l_suppkey ORDER BY at_ms) AS last_here FROM pairs),
    away AS (SELECT *, min(at_ms) OVER (PARTITION BY l_suppkey, last_here) AS missed FROM since WHERE NOT here AND last_here IS NOT NULL),
    judged AS (SELECT *, alarming AND at_ms - missed < {24 * HOUR} AS bad FROM away),
    told AS (SELECT *, coalesce(bool_or(NOT bad) OVER (PARTITION BY l_suppkey, last_here ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS forgotten FROM judged)
    SELECT 'c' || l_suppkey % 5 || ' / i-' || l_suppkey AS subject, at_ms, bad
    FROM (SELECT l_suppkey, at_ms, bad FROM told WHERE NOT forgotten UNION ALL SELECT l_suppkey, at_ms, l_suppkey % 19 = 0 FROM seen)""")
def alert_instances(spark, sf_dir):
    """Suppliers as instances, there at some checks; clusters are short of tasks at two of three times three checks."""
    items = views.table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(_CHECK).alias("at_ms"), "l_quantity")
    seen = items.groupBy("l_suppkey", "at_ms").agg(F.sum("l_quantity").alias("q")).filter(_HERE.replace("//", "DIV"))
    cluster = F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("cluster")
    history = seen.select("at_ms", cluster, F.concat(F.lit("i-"), F.col("l_suppkey").cast("string")).alias("instance_id"),
                          F.lit("ACTIVE").alias("status"), (F.col("l_suppkey") % 19 != 0).alias("agent_connected"))
    services = items.select("at_ms", cluster, F.lit("ACTIVE").alias("status"), F.lit(2).alias("desired"),
                            F.expr(f"IF({_SHORT.replace('//', 'DIV')}, 1, 2)").alias("running")).distinct()
    return rules.ecs_instances(history, services, "r11").select("subject", "at_ms", "bad")


# ---- the service itself
@QUERIES.add("alert_top_errors", sql(f"""WITH e AS (SELECT elb_code || ' ' || method || ' ' || regexp_replace(path, '/[0-9a-f-]{{8,}}|/\\d+', '/…', 'g') AS what
      FROM v_req WHERE elb_code >= 500 AND elb_code <> 507 AND ts_ms BETWEEN {NOW - WINDOW * MINUTE} AND {NOW})
    SELECT what, count(*) AS n, (SELECT count(*) FROM e) AS total FROM e GROUP BY what ORDER BY n DESC, what LIMIT 3"""))
def alert_top_errors(spark, sf_dir):
    return rules.top_errors(views.requests(spark, sf_dir), NOW, WINDOW)


@QUERIES.add("alert_app_errors", sql(f"""SELECT 'Service API' AS subject, count(*) >= 100 AS bad, CAST(count(*) AS DOUBLE) AS value FROM v_req
    WHERE elb_code >= 500 AND elb_code <> 507 AND ts_ms BETWEEN {NOW - WINDOW * MINUTE} AND {NOW}"""))
def alert_app_errors(spark, sf_dir):
    return rules.app_errors(views.requests(spark, sf_dir), "r12", NOW, WINDOW, 100).select("subject", "bad", "value")


@QUERIES.add("alert_converter", sql("""SELECT 'Load balancer log converter' AS subject, false AS bad, 'C1' AS muted_by,
    arg_max(props, ts) AS message FROM events WHERE event_type = 'error'"""))
def alert_converter(spark, sf_dir):
    """Ledger commits and failed hours out of log lines: the newest failure is a muted one."""
    events = views.table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
                                                         F.col("props").alias("message"), "event_type")
    rows = rules.converter(events, events.filter("event_type = 'error'"), "r13", T0 + 30 * DAY, 30 * 24 * 60,
                           [Mute("C1", converter_errors=['"K":'])])
    return rows.select("subject", "bad", F.array_join("muted_by", ",").alias("muted_by"), "message")


@QUERIES.add("explain_paths", sql(f"""WITH m AS (SELECT * FROM v_bins WHERE {_NOW_T} AND tg = 'tg-c1'),
    c AS (SELECT method, path_group, elb_code, count(*) AS cn FROM m WHERE elb_code // 100 = 5 GROUP BY ALL),
    f AS (SELECT method, path_group, CAST(sum(cn) AS BIGINT) AS requests, first(elb_code ORDER BY cn DESC, elb_code DESC) AS top_code FROM c GROUP BY ALL)
    SELECT f.*, (SELECT count(*) FROM m WHERE m.method = f.method AND m.path_group = f.path_group) AS all_requests
    FROM f ORDER BY requests DESC, path_group, method LIMIT 3"""))
def explain_paths(spark, sf_dir):
    return _explain(spark, sf_dir)["paths"]


@QUERIES.add("explain_codes", sql(f"""SELECT elb_code, count(*) AS n, count(*) FILTER (tgt_code IS NOT NULL) AS app FROM v_bins
    WHERE {_NOW_T} AND tg = 'tg-c1' AND elb_code // 100 = 5 GROUP BY elb_code"""))
def explain_codes(spark, sf_dir):
    return _explain(spark, sf_dir)["codes"]


@QUERIES.add("explain_usual", sql(f"""SELECT tg, 100.0::DOUBLE * n / total AS usual, n AS usual_n, total AS usual_total FROM (
    SELECT tg, count(*) FILTER (elb_code // 100 = 5) AS n, count(*) AS total FROM v_bins WHERE {_DAY_T} AND tg = 'tg-c1' GROUP BY tg)"""))
def explain_usual(spark, sf_dir):
    return _explain(spark, sf_dir)["usual"]


@QUERIES.add("explain_errors", sql(f"""WITH own AS (SELECT * FROM v_logs WHERE cluster = 'c1' AND lower(level) = 'error' AND log_time_ms BETWEEN {START - 2 * MINUTE} AND {END + 2 * MINUTE}),
    {kinds_sql('own', EXCEPTION_SQL)}, {TEMPLATES_SQL}, counted AS (SELECT count(*) AS kinds, CAST(sum(n) AS BIGINT) AS total FROM g)
    SELECT exception, key, n, error, kinds, total FROM g JOIN e USING (exception, key), counted WHERE lower(example || ' ' || error) NOT LIKE '%user 45%'"""))
def explain_errors(spark, sf_dir):
    return _explain(spark, sf_dir)["errors"].select("exception", "key", "n", "error", "kinds", "total")


def _explain(spark, sf_dir):
    requests = views.requests(spark, sf_dir)
    tables = lb.RequestTables(requests, access.minute_rollup(requests), access.path_rollup(requests))
    return rules.explain(tables, views.logs(spark, sf_dir), "tg-c1", ["5xx"], START, END,
                         views.inventory(spark, sf_dir), ["user 45"])


# ---- state
_SHARES = f"""SELECT tg AS subject, ts_ms // {6 * HOUR} * {6 * HOUR} AS at_ms, round(100.0::DOUBLE * count(*) FILTER (elb_code >= 500) / count(*), 2) AS value,
    min(cluster) AS cluster FROM v_req WHERE tg IS NOT NULL GROUP BY ALL"""
#: a subject's findings one after another; level: 0 to 2, phase and counters as they are after a finding
_WALK = f"""f AS ({_SHARES}),
    c AS (SELECT at_ms, lead(at_ms) OVER (ORDER BY at_ms) AS following FROM (SELECT DISTINCT at_ms FROM f)),
    own AS (SELECT *, lead(at_ms) OVER (PARTITION BY subject ORDER BY at_ms) AS again FROM f),
    every AS (SELECT subject, at_ms, value, cluster, false AS gone FROM f
              UNION ALL SELECT subject, following, value, cluster, true FROM own JOIN c USING (at_ms) WHERE following IS NOT NULL AND (again IS NULL OR again > following)),
    numbered AS (SELECT *, subject = 'tg-c5' AND value >= 25 AND NOT gone AS mute, row_number() OVER (PARTITION BY subject ORDER BY at_ms, gone DESC) AS k FROM every),
    walk AS (
      SELECT subject, 0::BIGINT AS k, 'ok' AS phase, 0 AS level, 0 AS seen, 0 AS climbs, 0::BIGINT AS told, NULL::VARCHAR AS event, NULL::INTEGER AS event_level,
             NULL::BIGINT AS at_ms, NULL::DOUBLE AS value, NULL::VARCHAR AS cluster FROM (SELECT DISTINCT subject FROM numbered)
      UNION ALL
      SELECT subject, k,
        CASE WHEN gone THEN 'ok' WHEN mute THEN CASE WHEN was IN ('firing', 'muted') OR n >= 2 THEN 'muted' ELSE 'holding' END
             WHEN now = 0 THEN 'ok' WHEN was = 'firing' OR n >= 2 THEN 'firing' ELSE 'pending' END,
        CASE WHEN gone OR (now = 0 AND NOT mute) THEN 0 WHEN mute THEN CASE WHEN was = 'firing' THEN 0 ELSE held END
             WHEN was <> 'firing' OR now < held OR (now > held AND up >= 2) THEN now ELSE held END,
        CASE WHEN gone OR (now = 0 AND NOT mute) THEN 0 WHEN mute AND was = 'firing' THEN 2 ELSE n END,
        CASE WHEN was = 'firing' AND NOT mute AND NOT gone AND now > held AND up < 2 THEN up ELSE 0 END,
        CASE WHEN kind IN ('firing', 'escalated', 'lowered', 'repeat') THEN at_ms ELSE told END,
        kind, CASE kind WHEN 'resolved' THEN held WHEN 'repeat' THEN held WHEN 'muted' THEN greatest(CASE WHEN was = 'firing' THEN held ELSE 0 END, 1) ELSE now END,
        at_ms, value, cluster
      FROM (SELECT *, CASE WHEN gone THEN CASE WHEN was = 'firing' THEN 'resolved' END
                           WHEN mute THEN CASE WHEN was = 'firing' OR (was <> 'muted' AND n >= 2) THEN 'muted' END
                           WHEN now = 0 THEN CASE WHEN was = 'firing' THEN 'resolved' END
                           WHEN was <> 'firing' THEN CASE WHEN n >= 2 THEN 'firing' END
                           WHEN now < held THEN 'lowered' WHEN now > held AND up >= 2 THEN 'escalated'
                           WHEN at_ms - told >= CASE held WHEN 2 THEN 12 ELSE 24 END * {HOUR} - 5000 THEN 'repeat' END AS kind
            FROM (SELECT n.*, w.phase AS was, w.level AS held, w.told,
                         CASE WHEN w.phase IN ('holding', 'muted') AND NOT n.mute THEN 0 ELSE w.seen END + 1 AS n, w.climbs + 1 AS up,
                         CASE WHEN n.value >= 40 OR (w.phase = 'firing' AND w.level = 2 AND n.value > 35) THEN 2
                              WHEN n.value >= 25 OR (w.phase = 'firing' AND n.value > 20) THEN 1 ELSE 0 END AS now
                  FROM walk w JOIN numbered n ON n.subject = w.subject AND n.k = w.k + 1)))"""


@QUERIES.add("alert_transitions", sql(f"""WITH {_WALK}
    SELECT 'share' AS rule_id, subject, at_ms, event, CASE event_level WHEN 2 THEN 'critical' ELSE 'warning' END AS level, value, cluster FROM walk WHERE event IS NOT NULL""")
    .replace("WITH ", "WITH RECURSIVE ", 1))
def alert_transitions(spark, sf_dir):
    found = views.rate_findings(spark, sf_dir)
    confirm = found.select("rule_id").distinct().selectExpr("rule_id", "2 AS confirm", "0 AS for_minutes", "'warning' AS base_level")
    return state.transitions(found, confirm, {"warning": 24 * 60, "critical": 12 * 60}).drop("muted_by")


@QUERIES.add("alert_gone", sql("""WITH f AS (SELECT tg AS subject, ts_ms // 3600000 * 3600000 AS at_ms FROM v_req WHERE tg IS NOT NULL GROUP BY ALL),
    c AS (SELECT at_ms, lead(at_ms) OVER (ORDER BY at_ms) AS next_check FROM (SELECT DISTINCT at_ms FROM f)),
    s AS (SELECT *, lead(at_ms) OVER (PARTITION BY subject ORDER BY at_ms) AS next_seen FROM f)
    SELECT subject, next_check AS at_ms FROM s JOIN c USING (at_ms) WHERE next_check IS NOT NULL AND (next_seen IS NULL OR next_seen > next_check)"""))
def alert_gone(spark, sf_dir):
    """The checks at which a subject is no longer reported."""
    rows = state.with_gone(state.complete(views.rate_findings(spark, sf_dir, 1)))
    return rows.filter("gone").select("subject", "at_ms")


_SNOOZED = """n AS (SELECT a.*, z.rule_id IS NOT NULL AND (z.until IS NULL OR z.until > a.at_ms) AND NOT (event = 'resolved' AND z.until IS NULL) AS snoozed
    FROM v_alert a LEFT JOIN v_snooze z USING (rule_id, subject))"""


@QUERIES.add("snoozed", sql(f"WITH {_SNOOZED} SELECT rule_id, subject, at_ms, event, coalesce(snoozed, false) AS snoozed FROM n "
                            "WHERE NOT (coalesce(snoozed, false) AND event = 'repeat')"))
def snoozed(spark, sf_dir):
    rows = state.apply_snoozes(views.alert_events(spark, sf_dir), views.snoozes(spark, sf_dir))
    return rows.select("rule_id", "subject", "at_ms", "event", "snoozed")


@QUERIES.add("alert_board", sql(f"""WITH l AS (SELECT rule_id, subject, arg_max(event, at_ms) AS event, arg_max(level, at_ms) AS level, max(at_ms) AS at_ms,
      max(at_ms) FILTER (event = 'firing') AS fired_ms FROM v_alert GROUP BY ALL)
    SELECT rule_id, subject, CASE WHEN event = 'muted' THEN 'muted' ELSE 'firing' END AS state, level, l.at_ms, fired_ms,
           z.rule_id IS NOT NULL AS snoozed, z.until
    FROM l LEFT JOIN (SELECT * FROM v_snooze WHERE until IS NULL OR until > {T0 + 15 * DAY}) z USING (rule_id, subject) WHERE event <> 'resolved'"""))
def alert_board(spark, sf_dir):
    rows = state.board(views.alert_events(spark, sf_dir), views.snoozes(spark, sf_dir), T0 + 15 * DAY)
    return rows.select("rule_id", "subject", "state", "level", "at_ms", "fired_ms", "snoozed", "until")


@QUERIES.add("mute_hits", sql(f"""SELECT mute_id, count(*) FILTER (at_ms >= {NOW - DAY}) AS muted_24h, count(*) AS muted_7d FROM v_alert
    WHERE event = 'muted' AND at_ms >= {NOW - 7 * DAY} GROUP BY mute_id"""))
def mute_hits(spark, sf_dir):
    return state.mute_hits(views.alert_events(spark, sf_dir), NOW)


@QUERIES.add("digest", sql(f"""WITH w AS (SELECT * FROM v_alert WHERE at_ms >= {NOW - 7 * DAY} AND event IN ('firing', 'escalated')),
    s AS (SELECT rule_id, subject, count(*) FILTER (event = 'firing') AS started FROM w GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY started DESC, subject) AS r FROM s WHERE started > 0)
    SELECT rule_id, count(*) FILTER (event = 'firing') AS started, count(*) FILTER (event = 'escalated' OR level = 'critical') AS critical,
           (SELECT string_agg(subject || ' ×' || started, ', ' ORDER BY r) FROM t WHERE t.rule_id = w.rule_id AND r <= 3) AS top FROM w GROUP BY rule_id"""))
def digest(spark, sf_dir):
    rows = state.digest(views.alert_events(spark, sf_dir), NOW)
    return rows.withColumn("top", F.expr("array_join(transform(top, x -> x.subject || ' ×' || x.started), ', ')"))


@QUERIES.add("recap", sql(f"""WITH d AS (SELECT * FROM v_alert WHERE at_ms >= {NOW - DAY} AND at_ms < {NOW} AND event IN ('firing', 'escalated'))
    SELECT count(*) FILTER (event = 'firing') AS started,
           (SELECT count(*) FROM (SELECT DISTINCT rule_id, subject FROM d WHERE event = 'escalated' OR level = 'critical')) AS critical FROM d"""))
def recap(spark, sf_dir):
    return state.recap(views.alert_events(spark, sf_dir), NOW - DAY, NOW)


@QUERIES.add("recap_rules", sql(f"""SELECT rule_id, count(*) AS started FROM v_alert WHERE event = 'firing' AND at_ms >= {NOW - DAY} AND at_ms < {NOW}
    GROUP BY rule_id ORDER BY started DESC, rule_id LIMIT 4"""))
def recap_rules(spark, sf_dir):
    return state.recap_rules(views.alert_events(spark, sf_dir), NOW - DAY, NOW)


# ---- access
@QUERIES.add("access_levels", sql("""SELECT p."user", p.cluster, CASE WHEN coalesce(o.level, s.level) = 'view' THEN 'view' END AS level
    FROM (SELECT DISTINCT 'u' || c_custkey % 70 AS "user", 'c' || c_custkey % 30 AS cluster FROM customer) p
    LEFT JOIN v_grant o ON o."user" = p."user" AND o.cluster = p.cluster LEFT JOIN v_grant s ON s."user" = p."user" AND s.cluster = '*'"""))
def access_levels(spark, sf_dir):
    pairs = views.table(spark, sf_dir, "customer").selectExpr("'u' || c_custkey % 70 AS user", "'c' || c_custkey % 30 AS cluster").distinct()
    return grants.access_levels(pairs, views.grants(spark, sf_dir))


@QUERIES.add("cluster_readers", sql("""SELECT c.cluster, string_agg(u."user", ',' ORDER BY u."user") AS users
    FROM v_cluster c CROSS JOIN (SELECT DISTINCT "user" FROM v_grant) u
    LEFT JOIN v_grant o ON o."user" = u."user" AND o.cluster = c.cluster LEFT JOIN v_grant s ON s."user" = u."user" AND s.cluster = '*'
    WHERE coalesce(o.level, s.level) = 'view' GROUP BY c.cluster"""))
def cluster_readers(spark, sf_dir):
    clusters = views.inventory(spark, sf_dir)["clusters"]
    return grants.cluster_readers(clusters, views.grants(spark, sf_dir)).withColumn("users", F.array_join("users", ","))


@QUERIES.add("visible_requests", sql("""SELECT r.cluster, count(*) AS n FROM v_req r LEFT JOIN v_grant o ON o."user" = 'u6' AND o.cluster = r.cluster
    WHERE r.cluster IS NOT NULL AND coalesce(o.level, (SELECT level FROM v_grant WHERE "user" = 'u6' AND cluster = '*')) = 'view' GROUP BY r.cluster"""))
def visible_requests(spark, sf_dir):
    rows = grants.visible(views.requests(spark, sf_dir), "u6", views.grants(spark, sf_dir))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"))
