"""Readers and stores: data sets are written to the session's shared folder as they come in, and read back."""
from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions.times import DAY, HOUR
from ..operators import search
from ..operators.orders import OrderLine
from ..session import shared_folder
from ..sources import readers, writers
from ..streaming import convert, inbound as inbound_stream, sightings
from . import views
from .ops import DELTA
from .oracle import sql
from .registry import Registry

QUERIES = Registry()

START, END = 1704067200000 + 5 * DAY + 7 * HOUR, 1704067200000 + 9 * DAY + 3 * HOUR


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/opslens-{uuid.uuid4().hex}/{name}"


@QUERIES.add("read_logs", sql(f"""SELECT row_id, log_time_ms, level, msg FROM v_logs WHERE cluster = 'c1'
    AND log_time_ms // {HOUR} BETWEEN {START // HOUR} AND {END // HOUR}"""))
def read_logs(spark, sf_dir):
    """Hour folders of every cluster; one cluster's range is read back out of a wider one."""
    root = _folder(spark, "logs")
    near = views.logs(spark, sf_dir).filter(F.col("log_time_ms").between(START - DAY, END + DAY))
    rows = writers.with_hour(near, "log_time_ms").withColumn("hour", F.format_string("%02d", "hour"))
    for cluster in ("c0", "c1"):
        rows.filter(F.col("cluster") == cluster).write.partitionBy("dt", "hour").parquet(f"{root}/{cluster}")
    assert readers.list_cluster_folders(spark, root) == ["c0", "c1"]
    return readers.read_logs(spark, root, "c1", START, END).select("row_id", "log_time_ms", "level", "msg")


@QUERIES.add("read_api_metrics", sql(f"SELECT t, api, stage, calls, err_4xx, err_5xx, p50, p95, ip95 FROM v_metric WHERE t >= {START} AND t < {END}"))
def read_api_metrics(spark, sf_dir):
    root = _folder(spark, "metrics")
    minute = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm'Z'").alias("minute")
    rows = views.metrics(spark, sf_dir).select(minute, "api", "stage", "calls", "err_4xx", "err_5xx", "p50", "p95", "ip95", F.to_date(F.timestamp_millis("t")).alias("dt"))
    rows.write.partitionBy("dt").option("header", True).csv(root)
    return readers.read_api_metrics(spark, readers.block_days(root, [(START, END)]), [(START, END)])


def _mixed_logs(spark, sf_dir) -> str:
    """Hours of one cluster in three layouts: a column grows from int to bigint, one turns into text, one has fractions or is missing."""
    root = _folder(spark, "mixed")
    near = views.logs(spark, sf_dir).filter(F.col("log_time_ms").between(START, END) & (F.col("cluster") == "c2"))
    rows = writers.with_hour(near, "log_time_ms").withColumn("kind", F.col("hour") % 3).withColumn("hour", F.format_string("%02d", "hour"))
    mark = F.concat(F.lit("m"), F.col("row_id").cast("string"))
    layouts = [[F.col("response_time_ms").cast("int").alias("took"), F.col("row_id").alias("mark"), (F.col("row_id") % 7).cast("int").alias("amount")],
               [F.col("response_time_ms").alias("took"), mark.alias("mark"), ((F.col("row_id") % 7) / 2).alias("amount")],
               [F.col("response_time_ms").alias("took"), F.col("parse_ok").alias("mark")]]
    for kind, columns in enumerate(layouts):
        rows.filter(F.col("kind") == kind).select("row_id", "log_time_ms", *columns, "dt", "hour").write.mode("append").partitionBy("dt", "hour").parquet(f"{root}/c2")
    return root


@QUERIES.add("read_logs_widened", sql(f"""SELECT row_id, log_time_ms, response_time_ms AS took,
    CASE log_time_ms // {HOUR} % 24 % 3 WHEN 0 THEN CAST(row_id AS VARCHAR) WHEN 1 THEN 'm' || row_id ELSE CAST(parse_ok AS VARCHAR) END AS mark,
    CASE log_time_ms // {HOUR} % 24 % 3 WHEN 0 THEN CAST(row_id % 7 AS DOUBLE) WHEN 1 THEN row_id % 7 / 2.0::DOUBLE END AS amount
    FROM v_logs WHERE cluster = 'c2' AND log_time_ms BETWEEN {START} AND {END}"""))
def read_logs_widened(spark, sf_dir):
    logs = readers.read_logs(spark, _mixed_logs(spark, sf_dir), "c2", START, END)
    return logs.select("row_id", "log_time_ms", "took", "mark", "amount")


@QUERIES.add("read_record", sql(f"""SELECT row_id, took, mark FROM (SELECT row_id, response_time_ms AS took, 'm' || row_id AS mark FROM v_logs
    WHERE cluster = 'c2' AND log_time_ms BETWEEN {START} AND {END} AND log_time_ms // {HOUR} % 24 % 3 = 1 ORDER BY row_id LIMIT 1)"""))
def read_record(spark, sf_dir):
    """One line in full, by the file and row that a search gave."""
    root = _mixed_logs(spark, sf_dir)
    logs = search.with_row_ref(readers.read_logs(spark, root, "c2", START, END))
    found = logs.filter("mark LIKE 'm%'").orderBy("row_id").select("_file", "_row").first()
    base = found["_file"][: found["_file"].index("/c2/")]
    return search.record(logs, f"{base}/c2", found["_file"], found["_row"]).select("row_id", "took", "mark")


@QUERIES.add("read_access_lines", "SELECT event_id || ' ' || event_type AS raw, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def read_access_lines(spark, sf_dir):
    """Lines of gz files, the empty ones left out."""
    root = _folder(spark, "lines")
    lines = views.table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 5 = 0 THEN '' ELSE event_id || ' ' || event_type END AS value", "event_id % 4 AS part")
    lines.write.partitionBy("part").option("compression", "gzip").text(root)
    return readers.read_access_lines(spark, root).groupBy("raw").agg(F.count("*").alias("n"))


@QUERIES.add("read_inbound", sql("""SELECT t, source, tenant, orders FROM v_inbound"""))
def read_inbound(spark, sf_dir):
    """Window files of two sources, read back with the source they came from."""
    rows = views.inbound(spark, sf_dir).filter("tenant <> '_all'").selectExpr(
        "date_format(timestamp_millis(t), \"yyyy-MM-dd'T'HH:mm'Z'\") AS minute", "tenant", "orders", "orders AS docs", "5L AS span_min", "'live' AS src", "source")
    paths = [_folder(spark, f"inbound{i}") for i in (0, 1)]
    for i, path in enumerate(paths):
        rows.filter(F.col("source") == i).drop("source").write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_inbound(spark, [[p] for p in paths]).select("t", "source", "tenant", "orders")


@QUERIES.add("read_session_counts", sql("SELECT minute_ms, source, store, page, category, value, n FROM v_count"))
def read_session_counts(spark, sf_dir):
    """Count files, in which an empty value is a value."""
    from .sessions import counts
    root = _folder(spark, "counts")
    minute = F.date_format(F.timestamp_millis("minute_ms"), "yyyy-MM-dd'T'HH:mm'Z'").alias("minute")
    rows = counts(spark, sf_dir).select(minute, "source", "store", "page", "category", "value", F.col("n").alias("count"))
    rows.write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(root)
    return readers.read_session_counts(spark, [root]).select("minute_ms", "source", "store", "page", "category", "value", "n")


@QUERIES.add("add_windows_once", sql("""SELECT t, tenant, CAST(sum(orders) AS BIGINT) AS orders, CAST(max(source) + 1 AS BIGINT) AS applied FROM v_inbound GROUP BY t, tenant"""))
def add_windows_once(spark, sf_dir):
    """Two batches of counts; the second one is applied twice, as after a failure."""
    rows = views.inbound(spark, sf_dir).filter("tenant <> '_all'").selectExpr("t", "tenant", "orders", "orders AS docs", "5L AS span_min", "'live' AS src", "t AS at", "source")
    one, two = (rows.filter(F.col("source") == i).drop("source") for i in (0, 1))
    table = one.limit(0).withColumn("applied", F.lit(0).cast("bigint"))
    for batch, fresh in ((1, one), (2, two), (2, two)):
        table = writers.add_windows_once(table, fresh, batch)
    return table.select("t", "tenant", "orders", "applied")


_RUN = (START, START + 6 * HOUR)


@QUERIES.add("convert_store", f"""SELECT epoch_us(ts) // 60000000 * 60000 AS minute_ms, 'elb-' || user_id % 3 AS lb, count(*) AS n
    FROM events WHERE epoch_us(ts) // 1000 >= {_RUN[0]} AND epoch_us(ts) // 1000 < {_RUN[1]} GROUP BY ALL""")
def convert_store(spark, sf_dir):
    """A range of log files converted beside a broken one, a late file that re-merges its hours, and the minutes read back."""
    root = _folder(spark, "convert")
    store = convert.RequestStore(f"{root}/store")
    at = F.unix_millis(F.to_timestamp(F.split("raw", " ")[1]))
    lines = views.access_lines(spark, sf_dir).filter((at >= _RUN[0]) & (at < _RUN[1])).selectExpr("raw AS value", "row_id % 3 AS part")
    writers.create_note(spark, f"{root}/logs/part=0/broken.log.gz", "this is not compressed")
    for parts in ((0, 1), (2,)):
        lines.filter(F.col("part").isin(*parts)).write.mode("append").partitionBy("part").option("compression", "gzip").text(f"{root}/logs")
        convert.convert_range(spark, [f"{root}/logs"], store, _RUN[1] + DAY)
    assert [r.path.rsplit("/", 1)[1] for r in store.failures(spark).collect()] == ["broken.log.gz"]
    return store.tables(spark).minutes.groupBy("minute_ms", "lb").agg(F.sum("n").alias("n"))


_BOUGHT = OrderLine("purchase user", r"^purchase user (\d+) ", {"order": 1})
_JOINED = OrderLine("signup user", r"^signup user (\d+) ", {"order": 1})


@QUERIES.add("orders_recounted", sql(f"""SELECT CAST(to_timestamp(log_time_ms // 1000) AT TIME ZONE 'UTC' AS DATE) AS day, split_part(msg, ' ', 3) AS order_id, min(log_time_ms) AS first_ms
    FROM v_logs WHERE log_time_ms BETWEEN {START // DAY * DAY} AND {END // DAY * DAY - 1}
      AND (msg LIKE 'purchase%' OR msg LIKE 'signup%' AND log_time_ms >= {(START // DAY + 2) * DAY}) GROUP BY ALL"""))
def orders_recounted(spark, sf_dir):
    """Days counted by one definition; a second one counts all but the first two days anew."""
    store, logs = sightings.CountedOrders(_folder(spark, "counted")), views.logs(spark, sf_dir)
    first, last = (date.fromordinal(date(1970, 1, 1).toordinal() + ms // DAY) for ms in (START, END - DAY))
    old, new = (sightings.OrderService("shop", "c", lines) for lines in ([_BOUGHT], [_BOUGHT, _JOINED]))
    store.recount(old, logs, first, last)
    store.recount(new, logs, date.fromordinal(first.toordinal() + 2), last)
    return store.read(spark, ["shop"]).select("day", "order_id", "first_ms")


_CUTS = (788918400000, 833587200000)                             # 1995-01-01, 1996-06-01


@QUERIES.add("inbound_runs", DELTA)
def inbound_runs(spark, sf_dir):
    """Snapshots in three batches, the second one applied twice; a run at the cut comes half in one batch and half in the next."""
    root, rows, at = _folder(spark, "inbound_runs"), views.index_snapshots(spark, sf_dir), F.col("snapshot_ms")
    early = (at < _CUTS[0]) | (at == _CUTS[0]) & (F.pmod(F.xxhash64("index"), F.lit(2)) == 0)
    parts = [rows.filter(early), rows.filter(~early & (at < _CUTS[1])), rows.filter(at >= _CUTS[1])]
    for batch in (0, 1, 1, 2):
        inbound_stream.add_runs(parts[batch], root, batch)
    return inbound_stream.read_runs(spark, root)
