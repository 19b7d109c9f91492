"""Stand-in views: the test tables shaped like the operational data sets, in Spark.

``oracle.py`` writes the same views in SQL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import MINUTE, floor_to
from ..functions.web import cluster_of
from ..operators.access import with_url_parts
from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# epoch ms of a timestamp column, zone or not
_MS = "unix_millis(CAST({} AS TIMESTAMP))"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application log lines out of ``events``."""
    return table(spark, sf_dir, "events").selectExpr(
        f"{_MS.format('ts')} AS log_time_ms",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' "
        "WHEN 'click' THEN 'INFO' END AS level",
        "'svc-' || user_id % 5 AS service", "'host-' || event_id % 7 AS host",
        "CASE WHEN event_type = 'error' THEN 'java.lang.E' || user_id % 3 END AS exception",
        "'c' || user_id % 4 AS cluster", "event_type || ' user ' || user_id || ' ' || props AS msg",
        "CAST(floor(value) AS BIGINT) AS response_time_ms", "event_id % 50 <> 0 AS parse_ok", "event_id AS row_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line log lines out of ``documents``."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS row_id", "text AS msg", "source AS service",
                                                        "lang AS level")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows out of ``events``; the raw line holds the main fields."""
    return request_rows(table(spark, sf_dir, "events"))


def request_rows(events: DataFrame) -> DataFrame:
    base = events.selectExpr(
        f"{_MS.format('ts')} AS ts_ms", "'lb-' || user_id % 3 AS lb",
        "CASE WHEN user_id % 11 <> 0 THEN 'tg-c' || user_id % 8 END AS tg",
        "'d' || user_id % 2 || '.example.com' AS domain",
        "CASE WHEN event_type = 'click' THEN 'POST' WHEN event_type IN ('view', 'signup') THEN 'GET' "
        "WHEN event_type = 'purchase' THEN 'PUT' WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method",
        "CAST(CASE event_type WHEN 'error' THEN 500 + event_id % 4 WHEN 'purchase' THEN "
        "CASE WHEN event_id % 5 = 0 THEN 404 ELSE 201 END WHEN 'signup' THEN "
        "CASE WHEN event_id % 3 = 0 THEN 301 ELSE 200 END ELSE 200 END AS SMALLINT) AS elb_code",
        "'Root=1-' || event_id AS trace_id", "'10.0.' || user_id % 256 || '.' || event_id % 250 AS client_ip",
        "'https://d' || user_id % 2 || '.example.com/api/v1/s' || user_id % 6 || '.myshopify.com/' || event_type || '/' "
        "|| event_id AS url", "value / 100 AS seconds", "'10.1.0.' || user_id % 20 || ':8080' AS answering")
    rows = base.selectExpr(
        "*", "CASE WHEN elb_code <> 503 THEN elb_code END AS tgt_code", "CASE WHEN elb_code <> 503 THEN seconds END AS tgt_t",
        "CASE WHEN elb_code <> 503 THEN answering END AS target",
        """concat_ws(' ', lb, coalesce(tg, '-'), '"' || method || ' ' || url || '"', elb_code, client_ip, trace_id) AS raw""")
    return (with_url_parts(rows).withColumn("cluster", cluster_of(F.col("tg")))
            .select("ts_ms", "lb", "tg", "cluster", "domain", "method", "path", "path_group", "url", "elb_code",
                    "tgt_code", "client_ip", "target", "tgt_t", "trace_id", "raw"))


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw access log lines rendered from ``events``: quoted tokens, dashes, -1 timings, escapes."""
    when = "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || 'Z'"
    answered = "event_id % 13 <> 0"
    fields = [
        "'https'", when, "'app/elb-' || user_id % 3 || '/1a2b'",
        "'198.51.100.' || user_id % 250 || ':' || (1024 + event_id % 50000)",
        f"CASE WHEN {answered} THEN '10.0.32.' || user_id % 20 || ':80' ELSE '-' END",
        f"CASE WHEN {answered} THEN '0.001' ELSE '-1' END",
        f"CASE WHEN {answered} THEN CAST(user_id * 10 + event_id % 10 AS STRING) ELSE '-1' END",
        f"CASE WHEN {answered} THEN '0.000' ELSE '-1' END", f"CASE WHEN {answered} THEN '200' ELSE '503' END",
        f"CASE WHEN {answered} THEN '200' ELSE '-' END", "100 + event_id % 900", "event_id * 3",
        """'"' || CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END || ' https://api.example.com:443/v1/s' ||
           user_id % 6 || '.myshopify.com/' || event_type || '/' || event_id ||
           CASE WHEN event_id % 3 = 0 THEN '?x=' || user_id ELSE '' END || ' HTTP/1.1"'""",
        """CASE WHEN event_id % 7 = 0 THEN '"Mozilla/5.0 (X11; \\\\"q\\\\") Demo"' ELSE '"curl/8"' END""", "'-'", "'TLSv1.2'",
        "'arn:aws:elasticloadbalancing:us-west-2:111122223333:targetgroup/' || CASE WHEN user_id % 4 = 0 THEN "
        "'webhook-' || user_id % 3 ELSE 'tg-c' || user_id % 8 END || '/cd18'",
        """'"Root=1-' || event_id || '"'""", """'"api.example.com"'""", """'"-"'""", "'10'", when, """'"forward"'"""]
    return table(spark, sf_dir, "events").selectExpr("event_id AS row_id", f"concat_ws(' ', {', '.join(fields)}) AS raw")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API metric minutes out of ``events``; every event stands for 10 to 16 calls."""
    events = table(spark, sf_dir, "events").selectExpr(
        f"{_MS.format('ts')} AS ms", "'api' || user_id % 2 AS api", "'st' || user_id % 5 AS stage", "event_type",
        "event_id", "value").withColumn("t", floor_to("ms", MINUTE))
    return events.groupBy("t", "api", "stage").agg(
        F.expr("sum(10 + event_id % 7) AS calls"), F.expr("count_if(event_type = 'purchase') AS err_4xx"),
        F.expr("count_if(event_type = 'error' AND event_id % 3 = 0) AS err_5xx"),
        F.expr("round(min(value) * 10, 1) + 0.0317D AS p50"),
        F.expr("round(max(value) FILTER (WHERE event_type <> 'view') * 10, 1) + 0.0317D AS p95"),
        F.expr("floor(max(value) FILTER (WHERE event_type <> 'view') * 70) / 10 + 0.0317D AS ip95"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines seen by a service in a store, out of ``lineitem``."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS service", "'s' || l_suppkey % 4 AS store", "CAST(l_orderkey AS STRING) AS order_id",
        f"{_MS.format('l_shipdate')} + l_partkey % 1440 * 60000 AS ms")


HEALTH_PREFIX = "shop-health-"


def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session and checkout entries out of ``events``."""
    oc = "user_id % 3 <> 0 AND event_type NOT IN ('view', 'click', 'signup')"
    return table(spark, sf_dir, "events").selectExpr(
        f"{_MS.format('ts')} AS at_ms", "CASE WHEN user_id % 3 <> 0 THEN 'session' ELSE 'cop' END AS source",
        "'s' || user_id % 6 || CASE WHEN user_id % 3 <> 0 THEN '-session_history-2024.01' "
        "ELSE '-cop-derrh-2024.01-000002' END AS index",
        "CASE WHEN event_id % 17 <> 0 THEN CASE event_type WHEN 'view' THEN 'PDP' WHEN 'click' THEN 'CART' "
        "WHEN 'signup' THEN 'cop' ELSE 'OC' END END AS page",
        "CASE event_id % 9 WHEN 0 THEN 'M' || event_id WHEN 1 THEN 'M' || event_id WHEN 2 THEN 'NA' WHEN 3 THEN 'xyz123' "
        "WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN CAST(event_id AS STRING) "
        "WHEN 7 THEN '8628b242-3301-4180-b6b1-1a3efc0d9e11' ELSE CASE WHEN user_id % 2 = 0 "
        f"THEN '{HEALTH_PREFIX}x' ELSE 'app-' || event_id END END AS session_id",
        "CAST(event_id AS STRING) AS order_id", "'d' || event_id AS doc_id", f"CASE WHEN {oc} THEN 'EDD' END AS test",
        f"CASE WHEN {oc} THEN CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END END AS variant")


def index_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily document counts of order indexes out of ``orders``: counts grow by the day's orders."""
    daily = table(spark, sf_dir, "orders").selectExpr(
        f"{_MS.format('o_orderdate')} AS snapshot_ms",
        "'shop' || o_custkey % 12 || '.myshopify.com' || CASE o_custkey % 12 WHEN 3 THEN '-s' WHEN 4 THEN '-jg' ELSE '' END "
        "|| '-order-' || year(o_orderdate) AS index").groupBy("index", "snapshot_ms").agg(F.count("*").alias("fresh"))
    return daily.selectExpr(
        "snapshot_ms", "index", "'open' AS status",
        "sum(fresh) OVER (PARTITION BY index ORDER BY snapshot_ms) AS docs_count",
        "min(snapshot_ms) OVER (PARTITION BY index ORDER BY snapshot_ms) AS creation_ms")


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with up to three date fields, out of ``orders``."""
    ms = f"({_MS.format('o_orderdate')} + o_custkey % 288 * 300000)"
    return table(spark, sf_dir, "orders").selectExpr(
        "'shop' || o_custkey % 12 || '.myshopify.com' || CASE WHEN o_custkey % 12 = 3 THEN '-s' ELSE '' END || "
        "'-order-1996' AS index", f"CASE WHEN o_orderkey % 3 = 0 THEN {ms} END AS d1",
        f"CASE WHEN o_orderkey % 3 <= 1 THEN {ms} + 3600000 END AS d2",
        f"CASE WHEN o_orderkey % 7 <> 0 THEN {ms} + 7200000 END AS d3")


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound windows of two sources, ``_all`` rows included, out of ``orders``."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        f"{_MS.format('o_orderdate')} + o_custkey % 288 * 300000 AS t", "CAST(o_custkey % 2 AS INT) AS source",
        "'shop' || o_custkey % 12 || '.myshopify.com' AS tenant")
    tenants = rows.groupBy("t", "source", "tenant").agg(F.count("*").alias("orders"))
    covered = tenants.groupBy("t", "source").agg(F.sum("orders").alias("orders")).withColumn("tenant", F.lit("_all"))
    return tenants.unionByName(covered)


def inventory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """clusters, services, instances, targets and target groups out of nation, customer and supplier."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    targets = supplier.selectExpr(
        "'tg-c' || s_suppkey % 30 AS tg", "'i-' || s_suppkey AS target_id",
        "CASE WHEN s_suppkey % 7 = 0 THEN 'unhealthy' WHEN s_suppkey % 11 = 0 THEN 'draining' WHEN s_suppkey % 13 = 0 "
        "THEN 'unused' WHEN s_suppkey % 30 = 9 THEN 'unhealthy' ELSE 'healthy' END AS state",
        "CASE WHEN s_suppkey % 7 = 0 THEN 'Target.FailedHealthChecks' END AS reason")
    return {
        "clusters": table(spark, sf_dir, "nation").selectExpr("'c' || n_nationkey AS cluster"),
        "services": customer.selectExpr(
            "'c' || c_nationkey AS cluster", "'svc-' || c_custkey AS service", "'ACTIVE' AS status",
            "CAST(1 + c_custkey % 3 AS INT) AS desired",
            "CAST(CASE WHEN c_custkey % 500 = 0 THEN 0 WHEN c_custkey % 90 = 1 THEN 1 ELSE 1 + c_custkey % 3 END AS INT) "
            "AS running", "CASE WHEN c_custkey % 90 = 1 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS rollout",
            "CASE WHEN c_custkey % 40 = 0 THEN 'tg-c' || c_custkey % 30 END AS tg"),
        "instances": supplier.selectExpr(
            "'c' || s_nationkey AS cluster", "'i-' || s_suppkey AS instance_id",
            "CASE WHEN s_suppkey % 17 = 0 THEN 'DRAINING' ELSE 'ACTIVE' END AS status",
            "s_suppkey % 19 <> 0 AS agent_connected"),
        "targets": targets,
        "groups": targets.select("tg").distinct().withColumn("error", F.lit(None).cast("string")),
    }


def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPU points of clusters out of ``events``."""
    return table(spark, sf_dir, "events").selectExpr(
        "'c' || user_id % 4 AS cluster", "'cpu' AS metric", f"{_MS.format('ts')} AS t_ms", "value / 5 AS value")


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert history out of ``events``."""
    return table(spark, sf_dir, "events").selectExpr(
        "'r' || user_id % 6 AS rule_id", "'s' || user_id % 40 AS subject", f"{_MS.format('ts')} AS at_ms",
        "CASE event_id % 7 WHEN 0 THEN 'firing' WHEN 1 THEN 'firing' WHEN 2 THEN 'escalated' WHEN 3 THEN 'repeat' "
        "WHEN 4 THEN 'muted' WHEN 5 THEN 'lowered' ELSE 'resolved' END AS event",
        "CASE WHEN event_id % 7 = 2 OR event_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS level", "value",
        "CASE WHEN event_id % 7 = 4 THEN array('M' || event_id % 4) END AS muted_by", "'c' || user_id % 4 AS cluster")


def snoozes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").filter("user_id % 3 = 0 AND user_id < 120").select("user_id").distinct()
    return users.selectExpr("'r' || user_id % 6 AS rule_id", "'s' || user_id % 40 AS subject",
                            "CASE WHEN user_id % 2 = 0 THEN 1704067200000 + user_id * 21600000 END AS until")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access grants out of ``customer``: named clusters and '*'."""
    customer = table(spark, sf_dir, "customer")
    named = (customer.selectExpr("'u' || c_custkey % 50 AS user", "'c' || c_nationkey AS cluster", "c_custkey % 3 = 0 AS deny")
             .groupBy("user", "cluster").agg(F.expr("CASE WHEN bool_or(deny) THEN 'none' ELSE 'view' END AS level")))
    star = (customer.selectExpr("c_custkey % 60 AS u").distinct().filter("u % 2 = 0")
            .selectExpr("'u' || u AS user", "'*' AS cluster", "CASE WHEN u % 4 = 0 THEN 'none' ELSE 'view' END AS level"))
    return named.unionByName(star)


def rate_findings(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Error shares per target group and some hours as findings of one rule, out of ``events``."""
    rows = requests(spark, sf_dir).filter("tg IS NOT NULL")
    shares = rows.groupBy("tg", floor_to("ts_ms", hours * 60 * MINUTE).alias("at_ms")).agg(
        F.expr("round(100D * count_if(elb_code >= 500) / count(*), 2) AS value"), F.min("cluster").alias("cluster"))
    return shares.selectExpr("'share' AS rule_id", "tg AS subject", "at_ms", "value >= 25 AS bad", "value",
                             "CAST(NULL AS STRING) AS level", "25D AS warning", "40D AS critical", "5D AS h", "0 AS hold",
                             "cluster", "CAST(NULL AS STRING) AS message",
                             "CASE WHEN tg = 'tg-c5' AND value >= 25 THEN array('M1') ELSE CAST(array() AS ARRAY<STRING>) END "
                             "AS muted_by", "CAST(NULL AS STRING) AS muted_level")
