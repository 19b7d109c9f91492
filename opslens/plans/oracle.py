"""The stand-in views of ``views.py`` in SQL, composed into complete statements."""
from __future__ import annotations

import re

MINUTE = 60_000

VIEWS = {
    "v_logs": """
        SELECT epoch_us(ts) // 1000 AS log_time_ms,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG'
                               WHEN 'click' THEN 'INFO' END AS level,
               'svc-' || user_id % 5 AS service, 'host-' || event_id % 7 AS host,
               CASE WHEN event_type = 'error' THEN 'java.lang.E' || user_id % 3 END AS exception,
               'c' || user_id % 4 AS cluster, event_type || ' user ' || user_id || ' ' || props AS msg,
               CAST(floor(value) AS BIGINT) AS response_time_ms, event_id % 50 <> 0 AS parse_ok, event_id AS row_id
        FROM events""",
    "v_text": "SELECT doc_id AS row_id, text AS msg, source AS service, lang AS level FROM documents",
    "v_req0": """
        SELECT event_id, event_type, user_id, value, epoch_us(ts) // 1000 AS ts_ms, 'lb-' || user_id % 3 AS lb,
               CASE WHEN user_id % 11 <> 0 THEN 'tg-c' || user_id % 8 END AS tg,
               'd' || user_id % 2 || '.example.com' AS domain,
               CASE WHEN event_type = 'click' THEN 'POST' WHEN event_type IN ('view', 'signup') THEN 'GET'
                    WHEN event_type = 'purchase' THEN 'PUT' WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
               CAST(CASE WHEN event_type = 'error' THEN 500 + event_id % 4
                         WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 404 ELSE 201 END
                         WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 301 ELSE 200 END
                         ELSE 200 END AS SMALLINT) AS elb_code,
               'Root=1-' || event_id AS trace_id, '10.0.' || user_id % 256 || '.' || event_id % 250 AS client_ip
        FROM events""",
    "v_req1": """
        SELECT *, 'https://' || domain || '/api/v1/s' || user_id % 6 || '.myshopify.com/' || event_type || '/' ||
                  event_id AS url,
               CASE WHEN elb_code <> 503 THEN elb_code END AS tgt_code,
               CASE WHEN elb_code <> 503 THEN value / 100 END AS tgt_t,
               CASE WHEN elb_code <> 503 THEN '10.1.0.' || user_id % 20 || ':8080' END AS target,
               replace(tg, 'tg-', '') AS cluster, '/api/v1/s' || user_id % 6 || '.myshopify.com/' || event_type ||
               '/' || event_id AS path, '/api/v1/<store>/' || event_type || '/<n>' AS path_group
        FROM v_req0""",
    "v_req": """
        SELECT ts_ms, lb, tg, cluster, domain, method, path, path_group, url, elb_code, tgt_code, client_ip, target,
               tgt_t, trace_id, lb || ' ' || coalesce(tg, '-') || ' "' || method || ' ' || url || '" ' || elb_code ||
               ' ' || client_ip || ' ' || trace_id AS raw
        FROM v_req1""",
    "v_bins": """
        SELECT *, ts_ms // 60000 * 60000 AS minute_ms,
               CASE WHEN tgt_t IS NOT NULL THEN len(list_filter([0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750,
                    1000, 1500, 2000, 3000, 5000, 7500, 10000, 15000, 20000, 30000, 60000],
                    lambda e : e <= tgt_t * 1000)) - 1 END AS lat_bin
        FROM v_req""",
    "v_metric": """
        SELECT epoch_us(ts) // 60000000 * 60000 AS t, 'api' || user_id % 2 AS api, 'st' || user_id % 5 AS stage,
               CAST(sum(10 + event_id % 7) AS BIGINT) AS calls, count(*) FILTER (event_type = 'purchase') AS err_4xx,
               count(*) FILTER (event_type = 'error' AND event_id % 3 = 0) AS err_5xx,
               round(min(value) * 10, 1) + 0.0317::DOUBLE AS p50,
               round(max(value) FILTER (event_type <> 'view') * 10, 1) + 0.0317::DOUBLE AS p95,
               floor(max(value) FILTER (event_type <> 'view') * 70) / 10 + 0.0317::DOUBLE AS ip95
        FROM events GROUP BY ALL""",
    "v_sighting": """
        SELECT l_returnflag AS service, 's' || l_suppkey % 4 AS store, CAST(l_orderkey AS VARCHAR) AS order_id,
               epoch_ms(l_shipdate) + l_partkey % 1440 * 60000 AS ms FROM lineitem""",
    "v_session": """
        SELECT epoch_us(ts) // 1000 AS at_ms, CASE WHEN user_id % 3 <> 0 THEN 'session' ELSE 'cop' END AS source,
               's' || user_id % 6 AS store,
               upper(coalesce(CASE WHEN event_id % 17 <> 0 THEN CASE event_type WHEN 'view' THEN 'PDP'
                    WHEN 'click' THEN 'CART' WHEN 'signup' THEN 'cop' ELSE 'OC' END END, '(none)')) AS page,
               CASE event_id % 9 WHEN 0 THEN 'M' || event_id WHEN 1 THEN 'M' || event_id WHEN 2 THEN 'NA'
                    WHEN 3 THEN 'xyz123' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN CAST(event_id AS VARCHAR)
                    WHEN 7 THEN '8628b242-3301-4180-b6b1-1a3efc0d9e11'
                    ELSE CASE WHEN user_id % 2 = 0 THEN 'shop-health-x' ELSE 'app-' || event_id END END AS session_id,
               CASE event_id % 9 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'NA' WHEN 3 THEN 'xyz123'
                    WHEN 4 THEN 'empty' WHEN 5 THEN 'missing' WHEN 6 THEN 'numbers' WHEN 7 THEN 'uuid'
                    ELSE CASE WHEN user_id % 2 = 0 THEN 'health' ELSE 'other' END END AS category,
               CAST(event_id AS VARCHAR) AS order_id, 'd' || event_id AS doc_id,
               CASE WHEN user_id % 3 <> 0 AND event_type IN ('error', 'purchase') THEN 'EDD / ' ||
                    CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END END AS variant
        FROM events""",
    "v_count": """
        SELECT at_ms // 300000 * 300000 AS minute_ms, source, store, page, 'total' AS category, '' AS value,
               count(*) AS n FROM v_session GROUP BY ALL
        UNION ALL SELECT at_ms // 300000 * 300000, source, store, page, category, '', count(*) FROM v_session GROUP BY ALL
        UNION ALL SELECT at_ms // 300000 * 300000, source, store, page, 'variant', variant, count(*) FROM v_session
                  WHERE variant IS NOT NULL GROUP BY ALL""",
    "v_snap": """
        SELECT index, snapshot_ms, sum(fresh) OVER (PARTITION BY index ORDER BY snapshot_ms) AS docs_count,
               min(snapshot_ms) OVER (PARTITION BY index) AS creation_ms, tenant, variant
        FROM (SELECT 'shop' || o_custkey % 12 || '.myshopify.com' || CASE o_custkey % 12 WHEN 3 THEN '-s' WHEN 4
                     THEN '-jg' ELSE '' END || '-order-' || year(o_orderdate) AS index,
                     'shop' || o_custkey % 12 || '.myshopify.com' AS tenant,
                     CASE o_custkey % 12 WHEN 3 THEN 's' WHEN 4 THEN 'jg' END AS variant,
                     epoch_ms(o_orderdate) AS snapshot_ms, count(*) AS fresh
              FROM orders GROUP BY ALL)""",
    "v_inbound": """
        SELECT epoch_ms(o_orderdate) + o_custkey % 288 * 300000 AS t, CAST(o_custkey % 2 AS INTEGER) AS source,
               'shop' || o_custkey % 12 || '.myshopify.com' AS tenant, count(*) AS orders FROM orders GROUP BY ALL""",
    "v_target": """
        SELECT 'tg-c' || s_suppkey % 30 AS tg, 'i-' || s_suppkey AS target_id,
               CASE WHEN s_suppkey % 7 = 0 THEN 'unhealthy' WHEN s_suppkey % 11 = 0 THEN 'draining'
                    WHEN s_suppkey % 13 = 0 THEN 'unused' WHEN s_suppkey % 30 = 9 THEN 'unhealthy'
                    ELSE 'healthy' END AS state,
               CASE WHEN s_suppkey % 7 = 0 THEN 'Target.FailedHealthChecks' END AS reason FROM supplier""",
    "v_instance": """
        SELECT 'c' || s_nationkey AS cluster, 'i-' || s_suppkey AS instance_id,
               CASE WHEN s_suppkey % 17 = 0 THEN 'DRAINING' ELSE 'ACTIVE' END AS status,
               s_suppkey % 19 <> 0 AS agent_connected FROM supplier""",
    "v_service": """
        SELECT 'c' || c_nationkey AS cluster, 'svc-' || c_custkey AS service, CAST(1 + c_custkey % 3 AS INTEGER) AS desired,
               CAST(CASE WHEN c_custkey % 500 = 0 THEN 0 WHEN c_custkey % 90 = 1 THEN 1 ELSE 1 + c_custkey % 3 END
                    AS INTEGER) AS running,
               CASE WHEN c_custkey % 90 = 1 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS rollout,
               CASE WHEN c_custkey % 40 = 0 THEN 'tg-c' || c_custkey % 30 END AS tg FROM customer""",
    "v_cluster": "SELECT 'c' || n_nationkey AS cluster FROM nation",
    "v_link": """
        SELECT cluster, tg, string_agg(DISTINCT how, ',' ORDER BY how) AS linked_by FROM (
          SELECT s.cluster, s.tg, 'service' AS how FROM v_service s JOIN (SELECT DISTINCT tg FROM v_target) g USING (tg)
          UNION ALL SELECT i.cluster, t.tg, 'instances' FROM v_target t JOIN v_instance i ON t.target_id = i.instance_id
          UNION ALL SELECT c.cluster, g.tg, 'name' FROM v_cluster c JOIN (SELECT DISTINCT tg FROM v_target) g
                    ON g.tg = 'tg-' || c.cluster OR g.tg = c.cluster)
        GROUP BY cluster, tg""",
    "v_tg": """
        SELECT tg, count(*) AS total, count(*) FILTER (state = 'healthy') AS healthy,
               count(*) FILTER (state IN ('unhealthy', 'draining', 'unavailable', 'initial')) AS bad FROM v_target
        GROUP BY tg""",
    "v_alert": """
        SELECT 'r' || user_id % 6 AS rule_id, 's' || user_id % 40 AS subject, epoch_us(ts) // 1000 AS at_ms,
               CASE event_id % 7 WHEN 0 THEN 'firing' WHEN 1 THEN 'firing' WHEN 2 THEN 'escalated' WHEN 3 THEN 'repeat'
                    WHEN 4 THEN 'muted' WHEN 5 THEN 'lowered' ELSE 'resolved' END AS event,
               CASE WHEN event_id % 7 = 2 OR event_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS level, value,
               CASE WHEN event_id % 7 = 4 THEN 'M' || event_id % 4 END AS mute_id, 'c' || user_id % 4 AS cluster
        FROM events""",
    "v_snooze": """
        SELECT 'r' || user_id % 6 AS rule_id, 's' || user_id % 40 AS subject,
               CASE WHEN user_id % 2 = 0 THEN 1704067200000 + user_id * 21600000 END AS until
        FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0 AND user_id < 120)""",
    "v_grant": """
        SELECT 'u' || c_custkey % 50 AS "user", 'c' || c_nationkey AS cluster,
               CASE WHEN bool_or(c_custkey % 3 = 0) THEN 'none' ELSE 'view' END AS level FROM customer GROUP BY ALL
        UNION ALL SELECT 'u' || u, '*', CASE WHEN u % 4 = 0 THEN 'none' ELSE 'view' END
                  FROM (SELECT DISTINCT c_custkey % 60 AS u FROM customer) WHERE u % 2 = 0""",
    "v_util": "SELECT 'c' || user_id % 4 AS cluster, epoch_us(ts) // 1000 AS t_ms, value / 5 AS value FROM events",
}


def sql(body: str, **views: str) -> str:
    """The statement with the views it names in front, each view after the views it needs."""
    known = {**VIEWS, **views}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(known[name])
                ordered.append(name)
    visit(body)
    head = ", ".join(f"{n} AS ({known[n]})" for n in ordered)
    if not head:
        return body
    rest = body.strip()
    return f"WITH {head}, {rest[4:].lstrip()}" if rest[:4].upper() == "WITH" else f"WITH {head} {rest}"


EDGES = ("[0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 7500, 10000, 15000, "
         "20000, 30000, 60000]")


def percentile_sql(source: str, keys: str, quantiles: dict[str, float]) -> str:
    """Percentiles from bins of ``source(keys…, lat_bin)`` by running totals; one row per key."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    first = ", ".join(f"min(CASE WHEN upto >= {p} * total THEN lat_bin END) OVER ({part}) AS b_{name}"
                      for name, p in quantiles.items())
    values = ", ".join(f"max(CASE WHEN lat_bin = b_{name} THEN (lo + (hi - lo) * ({p} * total - (upto - n)) / n) / 1000 "
                       f"END) AS {name}" for name, p in quantiles.items())
    return f"""
        SELECT {lead}{values} FROM (
          SELECT *, {first} FROM (
            SELECT {lead}lat_bin, n, sum(n) OVER ({part} ORDER BY lat_bin) AS upto, sum(n) OVER ({part}) AS total,
                   {EDGES}[lat_bin + 1] AS lo, coalesce({EDGES}[lat_bin + 2], {EDGES}[lat_bin + 1]) AS hi
            FROM (SELECT {lead}lat_bin, count(*) AS n FROM {source} WHERE lat_bin IS NOT NULL
                  GROUP BY {lead}lat_bin)))
        {f"GROUP BY {keys}" if keys else ""}"""
