"""Session quality and A/B counts per store and page.

Entries are (at_ms, source, index, page, session_id, order_id, doc_id, test, variant); count rows are
(minute_ms, source, store, page, category, value, n).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions.figures import pct
from ..functions.names import category_rank, classify_session_id, page_rank, store_of_index
from ..functions.text import cut_to
from ..functions.times import HOUR, MINUTE, SESSION_RANGE_STEPS, Buckets, floor_to, range_step, within, zone_buckets

WINDOW = 5 * MINUTE
LOOKBACK_MS, CATCH_UP_MS = 15 * MINUTE, 12 * HOUR
BLOCK_MS = 4 * HOUR
SOURCES = ["session", "cop"]
ROW = ["minute_ms", "source", "store", "page", "category", "value"]
_GOOD = ", ".join(f"'{c}'" for c in P.GOOD_CATEGORIES)


def page_of(page: Column) -> Column:
    return F.upper(F.coalesce(page, F.lit("(none)")))


# ---- counting entries
def count_entries(entries: DataFrame, health_prefix: str, known: Sequence[str] = tuple(P.KNOWN_SESSION_VALUES)
                  ) -> DataFrame:
    """Count rows of 5-minute windows: the total, each category met, and the variants.

    Entries are first counted per category and variant; only those counts are split into rows.
    """
    test = F.when(F.col("test").isNotNull() & F.col("variant").isNotNull(), F.concat_ws(" / ", "test", "variant"))
    fine = entries.groupBy(
        floor_to("at_ms", WINDOW).alias("minute_ms"), "source", store_of_index(F.col("index")).alias("store"),
        page_of(F.col("page")).alias("page"),
        classify_session_id(F.col("session_id"), health_prefix, known).alias("kind"), test.alias("test")
    ).agg(F.count("*").alias("n"))
    rows = fine.withColumn("row", F.explode(F.expr(
        "array_compact(array(struct('total' AS category, '' AS value), struct(kind AS category, '' AS value), "
        "CASE WHEN test IS NOT NULL THEN struct('variant' AS category, test AS value) END))")))
    return rows.select(*ROW[:4], "row.*", "n").groupBy(*ROW).agg(F.sum("n").alias("n"))


def with_coverage(counts: DataFrame, start: int, end: int, sources: Sequence[str] = tuple(SOURCES)) -> DataFrame:
    """Count rows plus one ``_all`` total per source and window of [start, end), 0 included."""
    counts = counts.filter(within("minute_ms", start, end))
    totals = (counts.filter((F.col("category") == "total") & (F.col("store") != P.ALL))
              .groupBy("minute_ms", "source").agg(F.sum("n").alias("n")))
    grid = (counts.sparkSession.range(start, end, WINDOW).withColumnRenamed("id", "minute_ms")
            .withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources]))))
    every = grid.join(totals, ["minute_ms", "source"], "left").select(
        "minute_ms", "source", F.lit(P.ALL).alias("store"), F.lit("").alias("page"), F.lit("total").alias("category"),
        F.lit("").alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    return counts.unionByName(every)


def windows_to_count(counts: DataFrame, now: int, sources: Sequence[str] = tuple(SOURCES), look_back: int = LOOKBACK_MS, catch_up: int = CATCH_UP_MS
                     ) -> DataFrame:
    """minute_ms of the windows a run at ``now`` counts: the last ``look_back`` again, for late entries, and what is missing of the last ``catch_up``.

    A window is missing unless every source has its ``_all`` row. Windows before the first that was ever counted aren't; a table without counts
    asks for the last ``look_back`` only. The windows of ``catch_up`` are the rows of the result, however many counts there are.
    """
    end = now // WINDOW * WINDOW
    spark = counts.sparkSession
    total = counts.filter((F.col("store") == P.ALL) & F.col("source").isin(*sources))
    counted = (total.filter(within("minute_ms", end - catch_up, end)).groupBy("minute_ms").agg(F.count_distinct("source").alias("n"))
               .filter(F.col("n") == len(sources)).select("minute_ms"))
    first = F.coalesce(total.agg(F.min("minute_ms")).scalar(), F.lit(end))
    windows = spark.range(end - max(catch_up, look_back), end, WINDOW).withColumnRenamed("id", "minute_ms")
    again = windows.filter(F.col("minute_ms") >= end - look_back)
    missed = windows.filter((F.col("minute_ms") < end - look_back) & (F.col("minute_ms") >= first)).join(counted, "minute_ms", "left_anti")
    return again.unionByName(missed)


def as_ranges(windows: DataFrame, block: int = BLOCK_MS) -> DataFrame:
    """start_ms, end_ms of neighbouring windows, cut where files of ``block`` begin; blocks are independent of each other."""
    in_block = W.partitionBy("block").orderBy("minute_ms")
    rows = windows.select("minute_ms", floor_to("minute_ms", block).alias("block")).distinct()
    run = F.col("minute_ms") - F.row_number().over(in_block) * WINDOW
    return (rows.withColumn("run", run).groupBy("block", "run").agg(F.min("minute_ms").alias("start_ms"), (F.max("minute_ms") + WINDOW).alias("end_ms"))
            .select("start_ms", "end_ms"))


def bad_ids(entries: DataFrame, health_prefix: str, order_columns: Sequence[str] = ("order_id",), id_chars: int | None = None) -> DataFrame:
    """Entries whose session ID is neither valid nor a health check's, one row each; IDs cut to ``id_chars``, if given."""
    sid = F.col("session_id")
    kind = classify_session_id(sid, health_prefix)
    order = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in order_columns], F.lit(""))
    return (entries.filter(~F.coalesce(F.startswith(sid, F.lit("M")) | F.startswith(sid, F.lit(health_prefix)),
                                       F.lit(False)))
            .select(floor_to("at_ms", WINDOW).alias("minute_ms"), "source", store_of_index(F.col("index")).alias("store"),
                    page_of(F.col("page")).alias("page"), kind.alias("category"),
                    cut_to(F.coalesce(sid, F.lit("")), id_chars).alias("session_id"),
                    order.alias("order_id"), "doc_id", "at_ms"))


# ---- reading counts
_BAD = f"category NOT IN ({_GOOD})"
_SHOPPER = "CASE category WHEN 'total' THEN n WHEN 'health' THEN -n ELSE 0 END"


def _sum(value: str, test: str, name: str) -> Column:
    return F.expr(f"coalesce(sum({value}) FILTER (WHERE {test}), 0) AS {name}")


def store_table(counts: DataFrame) -> DataFrame:
    """Per store: shopper entries, bad IDs on order confirmation and checkout, and whether a test runs."""
    session, oc, cop = "source = 'session'", "source = 'session' AND page = 'OC'", "source <> 'session'"
    rows = counts.filter(F.col("store") != P.ALL).groupBy("store").agg(
        _sum(_SHOPPER, session, "entries"), _sum(_SHOPPER, oc, "oc"), _sum("n", f"{oc} AND {_BAD}", "oc_bad"),
        _sum(_SHOPPER, cop, "cop"), _sum("n", f"{cop} AND {_BAD}", "cop_bad"), _sum("n", "category = 'health'", "health"),
        F.expr("coalesce(bool_or(category = 'variant' AND n > 0), false) AS ab_test"),
        F.expr("count_if(category <> 'variant') AS kinds"))
    return (rows.filter("kinds > 0").drop("kinds")
            .withColumns({"oc_bad_pct": pct(F.col("oc_bad"), F.col("oc")),
                          "cop_bad_pct": pct(F.col("cop_bad"), F.col("cop"))})
            .orderBy(F.desc("entries"), F.desc("cop"), "store"))


def store_pages(counts: DataFrame) -> DataFrame:
    """(store, page, entries) of session entries."""
    return (counts.filter((F.col("store") != P.ALL) & (F.col("source") == "session") & (F.col("category") != "variant"))
            .groupBy("store", "page").agg(F.expr(f"sum({_SHOPPER}) AS entries")))


def store_checks(counts: DataFrame, store: str) -> DataFrame:
    """Per source and page of a store: total, shoppers, valid and bad IDs."""
    rows = counts.filter((F.col("store") == store) & (F.col("category") != "variant")).groupBy("source", "page").agg(
        _sum("n", "category = 'total'", "total"), _sum(_SHOPPER, "true", "shoppers"),
        _sum("n", "category = 'valid'", "valid"), _sum("n", _BAD, "bad"), _sum("n", "category = 'health'", "health"))
    return (rows.withColumn("bad_pct", pct(F.col("bad"), F.col("shoppers")))
            .orderBy(F.desc("source"), page_rank(F.col("page")), "page"))


def store_categories(counts: DataFrame, store: str) -> DataFrame:
    """Per source, page and category of a store: count and share of the page's shoppers."""
    kinds = (counts.filter((F.col("store") == store) & (F.col("category") != "variant"))
             .groupBy("source", "page", "category").agg(F.sum("n").alias("n")))
    shoppers = F.expr(f"sum({_SHOPPER})").over(W.partitionBy("source", "page"))
    return (kinds.withColumn("pct", pct(F.col("n"), shoppers)).filter("category <> 'total' AND n > 0")
            .orderBy(F.desc("source"), page_rank(F.col("page")), "page", category_rank(F.col("category")), "category"))


def store_variants(counts: DataFrame, store: str) -> DataFrame:
    """Per page and variant of a store: count and share of the page's variants."""
    rows = (counts.filter((F.col("store") == store) & (F.col("category") == "variant"))
            .groupBy("page", F.col("value").alias("variant")).agg(F.sum("n").alias("n")))
    share = pct(F.col("n"), F.sum("n").over(W.partitionBy("page")))
    return rows.withColumn("pct", share).orderBy(page_rank(F.col("page")), "page", F.desc("n"), "variant")


def range_buckets(start: int, end: int, zone: str) -> Buckets:
    return zone_buckets(start, end, zone, range_step(end - start, SESSION_RANGE_STEPS))


def store_series(counts: DataFrame, store: str, start: int, end: int, zone: str) -> DataFrame:
    """(t, series, n): shoppers per page, bad order confirmations and variants per bucket.

    A bucket is NULL unless every one of its 5-minute windows was counted.
    """
    b = range_buckets(start, end, zone)
    inside = counts.filter(within("minute_ms", start, end) & (F.col("source") == "session"))
    bucket = floor_to("minute_ms", b.step, b.first).alias("t")
    covered = (inside.filter(F.col("store") == P.ALL).groupBy(bucket)
               .agg(F.count_distinct("minute_ms").alias("windows")))
    name = F.expr(f"CASE WHEN category IN ('total', 'health') THEN 'page ' || page "
                  f"WHEN category = 'variant' AND page = 'OC' THEN 'variant ' || value "
                  f"WHEN page = 'OC' AND {_BAD} THEN 'bad OC' END")
    value = F.expr("CASE WHEN category = 'health' THEN -n ELSE n END")
    own = (inside.filter(F.col("store") == store).withColumn("series", name).filter("series IS NOT NULL")
           .groupBy(bucket, "series").agg(F.sum(value).alias("n")))
    grid = (own.select("series").distinct().withColumn(
        "t", F.explode(F.expr(f"sequence({b.first}L, {b.first + b.step * (b.count - 1)}L, {b.step}L)"))))
    return (grid.join(own, ["t", "series"], "left").join(covered, "t", "left")
            .select("t", "series", F.when(F.col("windows") >= b.step // WINDOW, F.coalesce("n", F.lit(0))).alias("n")))


def id_list(ids: DataFrame, store: str, source: str, page: str | None = None, category: str | None = None) -> DataFrame:
    rows = ids.filter((F.col("store") == store) & (F.col("source") == source))
    if page:
        rows = rows.filter(F.col("page") == page.upper())
    return rows.filter(F.col("category") == category) if category and category != "bad" else rows


def id_values(ids: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent session IDs of a selection, with the number of entries in all of it."""
    total = ids.agg(F.count("*")).scalar()
    return (ids.groupBy(F.col("session_id").alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "value").limit(limit).withColumn("total", total))


def id_page(ids: DataFrame, limit: int = 500) -> DataFrame:
    """The newest entries of a selection."""
    return ids.orderBy(F.desc("at_ms"), "doc_id").limit(limit)
