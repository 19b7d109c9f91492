"""Session quality, A/B counts and service inventory."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import name_from_arn
from ..functions.times import DAY, HOUR, MINUTE
from ..operators import health, sessions
from . import views
from .oracle import sql
from .registry import Registry

QUERIES = Registry()

PREFIX = views.HEALTH_PREFIX
START, END = 1704067200000 + 3 * DAY, 1704067200000 + 17 * DAY + 50 * MINUTE
_GOOD = "('total', 'valid', 'health', 'variant')"


def counts(spark, sf_dir):
    return sessions.count_entries(views.session_entries(spark, sf_dir), PREFIX)


@QUERIES.add("session_categories", sql("SELECT order_id, source, store, page, category FROM v_session"))
def session_categories(spark, sf_dir):
    from ..functions.names import classify_session_id, store_of_index
    return views.session_entries(spark, sf_dir).select(
        "order_id", "source", store_of_index(F.col("index")).alias("store"), sessions.page_of(F.col("page")).alias("page"),
        classify_session_id(F.col("session_id"), PREFIX).alias("category"))


@QUERIES.add("ab_counts", sql("SELECT * FROM v_count"))
def ab_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@QUERIES.add("ab_coverage", sql(f"""WITH c AS (SELECT minute_ms, source FROM (SELECT unnest(range({START}, {END}, 300000)) AS minute_ms),
        (VALUES ('session'), ('cop')) s(source)),
    t AS (SELECT minute_ms, source, sum(n) AS n FROM v_count WHERE category = 'total' GROUP BY ALL)
    SELECT minute_ms, source, CAST(coalesce(n, 0) AS BIGINT) AS n FROM c LEFT JOIN t USING (minute_ms, source)"""))
def ab_coverage(spark, sf_dir):
    """One ``_all`` row per window and source, also where nothing happened."""
    rows = sessions.with_coverage(counts(spark, sf_dir), START, END)
    return rows.filter("store = '_all'").select("minute_ms", "source", "n")


_LACK = f"minute_ms // {DAY} % 3 = 1 AND minute_ms // {MINUTE} % 60 < 20 OR minute_ms // {HOUR} % 7 = 2 AND source = 'cop'"


@QUERIES.add("ab_catch_up", f"""WITH w AS (SELECT minute_ms FROM (SELECT unnest(range({START}, {END}, 300000)) AS minute_ms)
      WHERE minute_ms >= {END} - 900000 OR minute_ms // {DAY} % 3 = 1 AND minute_ms // {MINUTE} % 60 < 20 OR minute_ms // {HOUR} % 7 = 2),
    f AS (SELECT min(minute_ms) AS first_ms FROM (SELECT unnest(range({START}, {END}, 300000)) AS minute_ms), (VALUES ('session'), ('cop')) s(source) WHERE NOT ({_LACK})),
    g AS (SELECT minute_ms, minute_ms // 14400000 AS block, CASE WHEN minute_ms - lag(minute_ms) OVER (ORDER BY minute_ms) = 300000
      AND minute_ms % 14400000 <> 0 THEN 0 ELSE 1 END AS opens FROM w, f WHERE minute_ms >= first_ms OR minute_ms >= {END} - 900000),
    r AS (SELECT *, sum(opens) OVER (ORDER BY minute_ms) AS run FROM g)
    SELECT min(minute_ms) AS start_ms, max(minute_ms) + 300000 AS end_ms FROM r GROUP BY run""")
def ab_catch_up(spark, sf_dir):
    """Ranges still to count where runs were missed or one source failed, up to the whole span back, and the last 15 minutes."""
    rows = sessions.with_coverage(counts(spark, sf_dir), START, END)
    lacking = F.expr(f"minute_ms DIV {DAY} % 3 = 1 AND minute_ms DIV {MINUTE} % 60 < 20 OR minute_ms DIV {HOUR} % 7 = 2 AND source = 'cop'")
    return sessions.as_ranges(sessions.windows_to_count(rows.filter(~lacking), END + 2 * MINUTE, catch_up=END - START))


@QUERIES.add("ab_store_table", sql(f"""SELECT *, round(100.0::DOUBLE * oc_bad / nullif(oc, 0), 2) AS oc_bad_pct,
    round(100.0::DOUBLE * cop_bad / nullif(cop, 0), 2) AS cop_bad_pct FROM (
    SELECT store, count(*) FILTER (source = 'session') - count(*) FILTER (source = 'session' AND category = 'health') AS entries,
      count(*) FILTER (source = 'session' AND page = 'OC') - count(*) FILTER (source = 'session' AND page = 'OC' AND category = 'health') AS oc,
      count(*) FILTER (source = 'session' AND page = 'OC' AND category NOT IN {_GOOD}) AS oc_bad,
      count(*) FILTER (source <> 'session' AND category <> 'health') AS cop,
      count(*) FILTER (source <> 'session' AND category NOT IN {_GOOD}) AS cop_bad,
      count(*) FILTER (category = 'health') AS health, count(variant) > 0 AS ab_test
    FROM v_session WHERE at_ms >= {START} AND at_ms < {END} GROUP BY store)"""))
def ab_store_table(spark, sf_dir):
    return sessions.store_table(sessions.with_coverage(counts(spark, sf_dir), START, END))


@QUERIES.add("ab_store_pages", sql("""SELECT store, page, count(*) FILTER (category <> 'health') AS entries FROM v_session
    WHERE source = 'session' GROUP BY ALL"""))
def ab_store_pages(spark, sf_dir):
    return sessions.store_pages(counts(spark, sf_dir))


@QUERIES.add("ab_store_checks", sql(f"""SELECT *, round(100.0::DOUBLE * bad / nullif(shoppers, 0), 2) AS bad_pct FROM (
    SELECT source, page, count(*) AS total, count(*) FILTER (category <> 'health') AS shoppers, count(*) FILTER (category = 'valid') AS valid,
           count(*) FILTER (category NOT IN {_GOOD}) AS bad, count(*) FILTER (category = 'health') AS health
    FROM v_session WHERE store = 's4' GROUP BY ALL)"""))
def ab_store_checks(spark, sf_dir):
    return sessions.store_checks(counts(spark, sf_dir), "s4")


@QUERIES.add("ab_store_categories", sql("""SELECT source, page, category, count(*) AS n, round(100.0::DOUBLE * count(*) /
      nullif(any_value(shoppers), 0), 2) AS pct
    FROM (SELECT *, count(*) FILTER (category <> 'health') OVER (PARTITION BY source, page) AS shoppers FROM v_session WHERE store = 's4')
    GROUP BY source, page, category"""))
def ab_store_categories(spark, sf_dir):
    return sessions.store_categories(counts(spark, sf_dir), "s4")


@QUERIES.add("ab_variants", sql("""SELECT page, variant, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY page), 2) AS pct
    FROM (SELECT page, variant, count(*) AS n FROM v_session WHERE store = 's1' AND variant IS NOT NULL GROUP BY ALL)"""))
def ab_variants(spark, sf_dir):
    return sessions.store_variants(counts(spark, sf_dir), "s1")


_B = sessions.range_buckets(START, END, "IST")


@QUERIES.add("ab_series", sql(f"""WITH r AS (SELECT (at_ms // 300000 * 300000 - {_B.first}) // {_B.step} * {_B.step} + {_B.first} AS t, page,
        category, variant FROM v_session WHERE source = 'session' AND store = 's4' AND at_ms >= {START} AND at_ms < {END}),
    n AS (SELECT t, 'page ' || page AS series, count(*) FILTER (category <> 'health') AS n FROM r GROUP BY ALL
          UNION ALL SELECT t, 'bad OC', count(*) FROM r WHERE page = 'OC' AND category NOT IN {_GOOD} GROUP BY ALL
          UNION ALL SELECT t, 'variant ' || variant, count(*) FROM r WHERE page = 'OC' AND variant IS NOT NULL GROUP BY ALL),
    c AS (SELECT DISTINCT series, t FROM (SELECT series, unnest(range({_B.first}, {_B.first + _B.step * _B.count}, {_B.step})) AS t FROM n))
    SELECT c.t, c.series, CASE WHEN c.t >= {START} AND c.t + {_B.step} <= {END} THEN coalesce(n.n, 0) END AS n
    FROM c LEFT JOIN n USING (t, series)"""))
def ab_series(spark, sf_dir):
    rows = sessions.with_coverage(counts(spark, sf_dir), START, END)
    return sessions.store_series(rows, "s4", START, END, "IST")


_IDS = ("SELECT at_ms // 300000 * 300000 AS minute_ms, source, store, page, category, coalesce(session_id, '') AS session_id, order_id, "
        "doc_id, at_ms FROM v_session WHERE category NOT IN ('valid', 'health')")


@QUERIES.add("ab_bad_ids", sql(_IDS))
def ab_bad_ids(spark, sf_dir):
    return sessions.bad_ids(views.session_entries(spark, sf_dir), PREFIX)


@QUERIES.add("ab_id_values", sql(f"""WITH i AS ({_IDS}), s AS (SELECT * FROM i WHERE store = 's2' AND source = 'session')
    SELECT session_id AS value, count(*) AS n, (SELECT count(*) FROM s) AS total FROM s GROUP BY 1 ORDER BY n DESC, value LIMIT 50"""))
def ab_id_values(spark, sf_dir):
    ids = sessions.bad_ids(views.session_entries(spark, sf_dir), PREFIX)
    return sessions.id_values(sessions.id_list(ids, "s2", "session"))


@QUERIES.add("ab_id_page", sql(f"""WITH i AS ({_IDS}) SELECT * FROM i WHERE store = 's4' AND source = 'session' AND page = 'OC'
    AND category = 'xyz123' ORDER BY at_ms DESC, doc_id LIMIT 500"""))
def ab_id_page(spark, sf_dir):
    ids = sessions.bad_ids(views.session_entries(spark, sf_dir), PREFIX)
    return sessions.id_page(sessions.id_list(ids, "s4", "session", "oc", "xyz123"))


# ---- service inventory
@QUERIES.add("health_links", sql("SELECT cluster, tg, linked_by FROM v_link"))
def health_links(spark, sf_dir):
    return health.links(views.inventory(spark, sf_dir)).withColumn("linked_by", F.array_join("linked_by", ","))


@QUERIES.add("health_unlinked", sql("""SELECT DISTINCT tg FROM v_target WHERE tg NOT IN (SELECT 'tg-' || cluster FROM v_cluster)
    AND tg NOT IN (SELECT tg FROM v_service WHERE tg IS NOT NULL)"""))
def health_unlinked(spark, sf_dir):
    """Target groups no cluster uses by name or service (by their instances, all are used here)."""
    snap = views.inventory(spark, sf_dir)
    linked = health.links(snap).filter("linked_by <> array('instances')")
    return health.unlinked_groups(snap, linked).select("tg")


@QUERIES.add("health_instances", sql("""SELECT cluster, instance_id, status, agent_connected, EXISTS (SELECT 1 FROM v_target t JOIN v_link l ON l.tg = t.tg
    WHERE t.target_id = v_instance.instance_id AND l.cluster = v_instance.cluster) AS behind_balancer FROM v_instance"""))
def health_instances(spark, sf_dir):
    snap = views.inventory(spark, sf_dir)
    return health.instances_behind(snap, health.links(snap))


@QUERIES.add("health_groups", sql("""SELECT tg, count(*) AS total, count(*) FILTER (state = 'healthy') AS healthy,
    count(*) FILTER (state IN ('unhealthy', 'draining', 'unavailable', 'initial')) AS bad, count(*) FILTER (state = 'unused') AS other
    FROM v_target GROUP BY tg"""))
def health_groups(spark, sf_dir):
    return health.target_group_health(views.inventory(spark, sf_dir)["targets"])


_HEALTH = """
    g AS (SELECT cluster, count(*) AS groups, CAST(sum(healthy) AS BIGINT) AS healthy_targets, CAST(sum(total) AS BIGINT) AS targets,
                 CAST(sum(bad) AS BIGINT) AS bad_targets, bool_or(healthy = 0) AS group_down, bool_or(bad > 0) AS group_bad
          FROM v_link JOIN v_tg USING (tg) GROUP BY cluster),
    s AS (SELECT cluster, CAST(sum(running) AS BIGINT) AS services_running, CAST(sum(desired) AS BIGINT) AS services_desired,
                 count(*) FILTER (running < desired) AS services_short, bool_or(desired > 0 AND running = 0) AS service_down,
                 bool_or(running < desired OR rollout = 'FAILED') AS service_bad FROM v_service GROUP BY cluster),
    i AS (SELECT cluster, bool_or(NOT agent_connected) AS agent_lost FROM v_instance GROUP BY cluster),
    h AS (SELECT cluster, coalesce(groups, 0) AS groups, coalesce(healthy_targets, 0) AS healthy_targets, coalesce(targets, 0) AS targets,
                 coalesce(bad_targets, 0) AS bad_targets, coalesce(services_running, 0) AS services_running,
                 coalesce(services_desired, 0) AS services_desired, coalesce(services_short, 0) AS services_short,
                 CASE WHEN coalesce(group_down, false) OR coalesce(service_down, false) THEN 'down'
                      WHEN coalesce(group_bad, false) OR coalesce(service_bad, false) OR coalesce(agent_lost, false) THEN 'degraded'
                      WHEN groups > 0 THEN 'healthy' ELSE 'none' END AS status
          FROM v_cluster LEFT JOIN g USING (cluster) LEFT JOIN s USING (cluster) LEFT JOIN i USING (cluster))"""


@QUERIES.add("health_status", sql(f"WITH {_HEALTH} SELECT * FROM h"))
def health_status(spark, sf_dir):
    return health.cluster_health(views.inventory(spark, sf_dir))


@QUERIES.add("health_summary", sql(f"""WITH {_HEALTH} SELECT count(*) AS clusters, count(*) FILTER (groups > 0) AS with_balancer,
    count(*) FILTER (groups = 0) AS without_balancer, count(*) FILTER (status = 'down') AS down, count(*) FILTER (status = 'degraded') AS degraded,
    count(*) FILTER (status = 'healthy') AS healthy, CAST(sum(bad_targets) AS BIGINT) AS unhealthy_targets,
    CAST(sum(services_short) AS BIGINT) AS services_below_desired FROM h"""))
def health_summary(spark, sf_dir):
    return health.health_summary(health.cluster_health(views.inventory(spark, sf_dir)))


@QUERIES.add("arn_names", sql("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'elb-' || s_nationkey WHEN s_suppkey % 3 = 1 "
                              "THEN 'tg-c' || s_nationkey ELSE s_name END AS name FROM supplier"))
def arn_names(spark, sf_dir):
    arn = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'arn:aws:elasticloadbalancing:r:1:loadbalancer/app/elb-' || s_nationkey || '/9f' "
                 "WHEN 1 THEN 'arn:aws:elasticloadbalancing:r:1:targetgroup/tg-c' || s_nationkey || '/9f' ELSE s_name END")
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", name_from_arn(arn).alias("name"))


# ---- utilisation
_HOURS = 24 * 20
_NOW = 1704067200000 + 20 * DAY


@QUERIES.add("utilisation", sql(f"""SELECT cluster, 'cpu' AS metric, arg_max(value, t_ms) AS now, round(avg(value), 6) AS avg, max(value) AS max
    FROM (SELECT cluster, t_ms // {_HOURS * MINUTE} * {_HOURS * MINUTE} AS t_ms, CAST(printf('%.2f', avg(value)) AS DOUBLE) AS value FROM v_util
          GROUP BY ALL) GROUP BY cluster"""))
def utilisation(spark, sf_dir):
    rows = health.utilisation(views.utilisation(spark, sf_dir), _HOURS)
    return rows.withColumn("avg", F.round("avg", 6))


@QUERIES.add("recent_average", sql(f"""SELECT cluster, 'cpu' AS metric, round(avg(value), 6) AS avg, max(value) AS peak FROM v_util
    WHERE t_ms >= {_NOW - 12 * HOUR} GROUP BY cluster"""))
def recent_average(spark, sf_dir):
    rows = health.recent_average(views.utilisation(spark, sf_dir), _NOW, 12 * 60)
    return rows.withColumn("avg", F.round("avg", 6))


@QUERIES.add("recent_average_fallback", sql(f"""SELECT cluster, 'cpu' AS metric,
      round(coalesce(avg(value) FILTER (t_ms >= {_NOW - MINUTE}), avg(value) FILTER (r <= 2)), 6) AS avg,
      coalesce(max(value) FILTER (t_ms >= {_NOW - MINUTE}), max(value) FILTER (r <= 2)) AS peak
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY t_ms DESC) AS r FROM v_util
          WHERE t_ms >= {_NOW - 16 * MINUTE} AND t_ms < {_NOW}) GROUP BY cluster"""))
def recent_average_fallback(spark, sf_dir):
    points = views.utilisation(spark, sf_dir).filter(F.col("t_ms") < _NOW)
    return health.recent_average(points, _NOW, 1).withColumn("avg", F.round("avg", 6))
