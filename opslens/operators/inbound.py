"""Inbound order windows: index snapshots to counts, days, ranges and backfill."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions.figures import change_pct
from ..functions.names import excluded, parse_order_index, tenant_name
from ..functions.times import HOUR, MINUTE, Buckets, ZoneDay, floor_to, range_step, within, zone_buckets

WINDOW = 5 * MINUTE


# ---- index names and snapshots
def classify_indexes(snapshot: DataFrame) -> DataFrame:
    """Every index of a snapshot with its parts and kind: counted, skipped, unmatched or closed.

    Hidden indexes (a leading dot) are left out.
    """
    parts = parse_order_index(F.col("index"))
    kind = (F.when(F.col("p").isNull(), "unmatched").when(F.col("p.variant").isNotNull(), "skipped")
            .when((F.col("status") == "close") | F.col("docs_count").isNull(), "closed").otherwise("counted"))
    return (snapshot.filter(~F.startswith("index", F.lit("."))).withColumn("p", parts).withColumn("kind", kind)
            .select("*", "p.*").drop("p"))


def group_order_indexes(snapshot: DataFrame) -> DataFrame:
    """Per tenant, year and month of one snapshot: total documents and the parts it is made of."""
    counted = classify_indexes(snapshot).filter("kind = 'counted'")
    return counted.groupBy("tenant", "year", "month").agg(
        F.sum("docs_count").alias("total"),
        F.sort_array(F.collect_list(F.struct("index", "part", F.col("docs_count").alias("count")))).alias("parts"))


def index_summary(snapshot: DataFrame) -> DataFrame:
    rows = classify_indexes(snapshot)
    counted = "kind = 'counted'"
    return rows.agg(
        F.expr(f"count(DISTINCT CASE WHEN {counted} THEN tenant END) AS tenants"),
        F.expr(f"count(DISTINCT CASE WHEN {counted} THEN struct(tenant, year, month) END) AS rows"),
        F.expr(f"count_if({counted}) AS indexes"), F.expr(f"coalesce(sum(docs_count) FILTER (WHERE {counted}), 0) AS orders"),
        *[F.expr(f"count_if(kind = '{k}') AS {k}") for k in ("skipped", "unmatched", "closed")])


def inbound_delta(snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """New orders per tenant between consecutive snapshots, as window rows of the earlier one's slot.

    An index that was in the run before counts its growth (a fall is 0); one seen for the first time
    counts only if it was created since that run (a minute of slack), else it is a starting point.
    Every window has its ``_all`` row, also with 0; tenants without new orders have none. ``keys``
    are columns of independent snapshot sources.

    Only run times pass through the ordered window over runs (288 a day); indexes are ordered per index.
    """
    runs = snapshots.select(*keys, "snapshot_ms").distinct()
    before = W.partitionBy(*keys).orderBy("snapshot_ms")
    runs = runs.withColumn("previous_ms", F.lag("snapshot_ms").over(before)).filter("previous_ms IS NOT NULL")
    counted = classify_indexes(snapshots).filter("kind = 'counted'")
    own = W.partitionBy(*keys, "index").orderBy("snapshot_ms")
    grown = (counted.withColumns({"seen_ms": F.lag("snapshot_ms").over(own), "seen_count": F.lag("docs_count").over(own)})
             .join(runs, [*keys, "snapshot_ms"]))
    fresh = (F.when(F.col("seen_ms") == F.col("previous_ms"),
                    F.greatest(F.lit(0), F.col("docs_count") - F.col("seen_count")))
             .when(F.col("creation_ms") >= F.col("previous_ms") - MINUTE, F.col("docs_count")).otherwise(0))
    per_tenant = (grown.groupBy(*keys, "snapshot_ms", "previous_ms", "tenant")
                  .agg(F.sum(fresh).alias("orders"), F.sum("docs_count").alias("docs")))
    everything = (runs.join(per_tenant.groupBy(*keys, "snapshot_ms").agg(F.sum("orders").alias("orders"),
                                                                        F.sum("docs").alias("docs")),
                            [*keys, "snapshot_ms"], "left")
                  .withColumns({"tenant": F.lit(P.ALL), "orders": F.coalesce("orders", F.lit(0)),
                                "docs": F.coalesce("docs", F.lit(0))}))
    rows = per_tenant.filter("orders > 0").unionByName(everything)
    span = F.greatest(F.lit(1), F.bround((F.col("snapshot_ms") - F.col("previous_ms")) / MINUTE)).cast("bigint")
    return rows.select(*keys, floor_to("previous_ms", WINDOW).alias("t"), "tenant", "orders", "docs",
                       span.alias("span_min"), F.lit("live").alias("src"), F.col("snapshot_ms").alias("at"))


# ---- reading windows
def as_of(windows: DataFrame, start: int, end: int) -> DataFrame:
    """Newest window every source has counted; a source with none in the range holds nobody back."""
    return (windows.filter((F.col("tenant") == P.ALL) & within("t", start, end))
            .groupBy("source").agg(F.max("t").alias("t")).agg(F.min("t").alias("t")))


def _counted(windows: DataFrame, exclude: Sequence[str]) -> DataFrame:
    return windows.filter((F.col("tenant") != P.ALL) & ~excluded(F.col("tenant"), exclude))


def inbound_day(windows: DataFrame, day: ZoneDay, before: ZoneDay, upto: int | None = None,
                exclude: Sequence[str] = ()) -> DataFrame:
    """Per tenant: today up to ``upto``, last week by that time, and last week's whole day. One scan."""
    upto = day.end if upto is None else upto
    cutoff = upto - (day.start - before.start)
    now, week = within("t", day.start, upto), within("t", before.start, before.end)
    rows = (_counted(windows, exclude).filter(now | week).groupBy("tenant").agg(
        F.coalesce(F.sum(F.when(now, F.col("orders"))), F.lit(0)).alias("orders"),
        F.coalesce(F.sum(F.when(week & (F.col("t") < cutoff), F.col("orders"))), F.lit(0)).alias("lw_orders"),
        F.coalesce(F.sum(F.when(week, F.col("orders"))), F.lit(0)).alias("lw_day_orders")))
    return (rows.filter("orders > 0 OR lw_orders > 0")
            .withColumns({"change": change_pct(F.col("orders"), F.col("lw_orders")),
                          "name": tenant_name(F.col("tenant"))}))


def inbound_hours(windows: DataFrame, day: ZoneDay, upto: int | None = None,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """(tenant, t, orders) per hour of the day."""
    upto = day.end if upto is None else upto
    return (_counted(windows, exclude).filter(within("t", day.start, upto))
            .groupBy("tenant", floor_to("t", HOUR, day.start).alias("t")).agg(F.sum("orders").alias("orders")))


def range_buckets(start: int, end: int, zone: str) -> Buckets:
    return zone_buckets(start, end, zone, max(WINDOW, range_step(end - start)))


def inbound_range(windows: DataFrame, start: int, end: int, zone: str, exclude: Sequence[str] = (),
                  tenant: str | None = None) -> DataFrame:
    """(t, orders) per bucket of at least one window; NULL where not everything was counted."""
    b = range_buckets(start, end, zone)
    inside = windows.filter(within("t", start, end))
    marks = inside.filter(F.col("tenant") == P.ALL)
    last = marks.groupBy("source").agg(F.max("t").alias("t")).agg(F.min("t") + WINDOW)
    counted = _counted(inside, exclude)
    if tenant:
        counted = counted.filter(F.col("tenant") == tenant)
    sums = counted.groupBy(floor_to("t", b.step, b.first).alias("t")).agg(F.sum("orders").alias("orders"))
    series = (windows.sparkSession.range(b.first, b.first + b.step * b.count, b.step, 1).withColumnRenamed("id", "t")
              .join(sums, "t", "left").withColumns({"upto": F.least(last.scalar(), F.lit(end)),
                                                    "lo": marks.agg(F.min("t")).scalar()}))
    known = (F.col("t") >= F.greatest(F.lit(start), F.col("lo"))) & (F.col("t") + b.step <= F.col("upto"))
    return series.select("t", F.when(known, F.coalesce("orders", F.lit(0))).alias("orders"))


def inbound_tenants(windows: DataFrame, start: int, end: int, exclude: Sequence[str] = ()) -> DataFrame:
    rows = _counted(windows.filter(within("t", start, end)), exclude)
    return rows.groupBy("tenant").agg(F.sum("orders").alias("orders")).filter("orders > 0")


# ---- backfill from order dates
def inbound_backfill(orders: DataFrame, date_columns: Sequence[str], start: int, end: int,
                     live: DataFrame | None = None) -> DataFrame:
    """5-minute counts by the first date an order has, with an ``_all`` row for every window of the range.

    Stops at the first live window: ``live`` windows from there on are never touched.
    """
    if live is not None:
        first = live.filter("src = 'live'").agg(F.min("t")).first()[0]
        end = end if first is None else min(end, first)
    end = end // WINDOW * WINDOW
    placed = orders.withColumn("at", F.coalesce(*date_columns)).filter(within("at", start, end))
    parts = parse_order_index(F.col("index"))
    tenants = (placed.withColumn("p", parts).filter("p IS NOT NULL AND p.variant IS NULL")
               .groupBy(floor_to("at", WINDOW).alias("t"), F.col("p.tenant").alias("tenant"))
               .agg(F.count("*").alias("orders")))
    sums = tenants.groupBy("t").agg(F.sum("orders").alias("orders"))
    every = (orders.sparkSession.range(start, end, WINDOW).withColumnRenamed("id", "t").join(sums, "t", "left")
             .select("t", F.lit(P.ALL).alias("tenant"), F.coalesce("orders", F.lit(0)).alias("orders")))
    return tenants.unionByName(every).withColumns({"span_min": F.lit(5).cast("bigint"), "src": F.lit("backfill")})


def compare_with_dates(live: DataFrame, by_date: DataFrame) -> DataFrame:
    """Live window counts against counts by order date over the same time, per tenant."""
    sums = lambda df, name: df.groupBy("tenant").agg(F.sum("orders").alias(name))
    return (sums(live.filter(F.col("tenant") != P.ALL), "live")
            .join(sums(by_date.filter(F.col("tenant") != P.ALL), "by_date"), "tenant", "full_outer")
            .na.fill(0, ["live", "by_date"]))

