from datetime import date, datetime, timezone

import pytest

from opslens.functions.times import DAY, HOUR, MINUTE, WEEK, zone_day
from opslens.operators import inbound, metrics, orders
from opslens.operators.orders import OrderLine
from opslens.sources import writers

METRIC = "t bigint, api string, stage string, calls bigint, err_4xx bigint, err_5xx bigint, p50 double, p95 double, ip95 double"
WEEKS = "calls bigint, err_4xx bigint, err_5xx bigint, p95 double, lw_calls bigint, lw_err_4xx bigint, lw_p95 double"


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("row, status, reasons", [
    ((5, 0, 5, None, 5, 0, None), "idle", []),
    ((0, 0, 0, None, 500, 0, None), "red", ["no calls (last week 500)"]),
    ((200, 0, 0, None, 1000, 0, None), "amber", ["calls 20% of last week"]),
    ((1000, 0, 0, 900.0, 1000, 0, 300.0), "red", ["p95 900 ms, 3.0× last week"]),
    ((1000, 0, 0, 250.0, 1000, 0, 100.0), "green", []),
    ((1000, 0, 0, 450.0, 1000, 0, 300.0), "amber", ["p95 450 ms, 1.5× last week"]),
    ((1000, 300, 0, None, 1000, 50, None), "amber", ["4xx 30.0% (last week 5.0%)"]),
    ((1000, 0, 6, None, 0, 0, None), "amber", ["5xx 0.6%"]),
    ((300, 0, 30, 1500.0, 1000, 0, 500.0), "red", ["5xx 10.0%", "p95 1,500 ms, 3.0× last week", "calls 30% of last week"])])
def test_judge(rows, row, status, reasons):
    got = rows([row], WEEKS).select("*", *metrics.judge()).first()
    assert (got.status, got.reasons) == (status, reasons)


def test_problem_stages(rows):
    day, before = zone_day(date(2026, 11, 9)), zone_day(date(2026, 11, 2))
    def row(d, name, calls, e5=0, p95=200.0):
        return (d.start, "A", name, calls, 0, e5, None, p95, None)
    data = [row(day, "a", 10_000, 60), row(day, "b", 10_000, 0, 900.0), row(day, "c", 300), row(day, "d", 10_000, 5)] + \
        [row(before, "a", 10_000), row(before, "b", 10_000, 0, 300.0), row(before, "c", 5_000), row(before, "e", 2_000), row(before, "d", 10_000)]
    got = [(r.stage, r.kind, r["rank"], r.value) for r in metrics.problem_stages(rows(data, METRIC), day, before).collect()]
    assert got == [("b", "p95", 2, 3.0), ("a", "5xx", 1, 0.6), ("c", "quiet", 0, 6.0), ("e", "quiet", 0, 0.0)]


def test_weighted_latency_skips_missing(rows):
    data = [(0, "a", "s", 10, 1, 0, None, 100.0, None), (MINUTE, "a", "s", 30, 0, 2, 20.0, 200.0, None), (2 * MINUTE, "a", "s", 60, 0, 0, 10.0, None, None)]
    got = metrics.stage_window(rows(data, METRIC), 0, HOUR).first()
    assert (got.calls, got.err_4xx, got.err_5xx, got.p50, got.p95, got.ip95) == (100, 1, 2, 13.3, 175.0, None)


def test_partly_covered_buckets_are_empty(rows):
    start, end = 5 * MINUTE, 3 * DAY
    data = [(t, "a", "s", 10, 0, 0, None, 50.0, None) for t in range(start, 2 * DAY, 5 * MINUTE)]
    series = {r.t: (r.calls, r.p95) for r in metrics.range_series(rows(data, METRIC), start, end, "UTC").collect()}
    assert series[0] == (None, 50.0) and series[15 * MINUTE] == (30, 50.0)
    assert series[2 * DAY - 15 * MINUTE] == (None, 50.0) and series[2 * DAY] == (None, None)       # newest minute is 4 short


def test_history_of_a_day_in_progress(rows):
    day = zone_day(date(2026, 11, 9))
    data = [(day.start + i * MINUTE, "a", "s", 1, 0, 0, None, None, None) for i in range(0, 90, 2)]
    series = metrics.minute_series(rows(data, METRIC), day, day.start + 88 * MINUTE)
    values = [r.calls for r in series.orderBy("t").collect()]
    assert values[:3] == [1, 0, 1] and values[88] == 1 and values[89] is None and len(values) == 1440
    total = [r.total for r in metrics.cumulative(series, "calls").orderBy("t").collect()]
    assert total[88] == 45 and total[89] is None
    half = [r.calls for r in metrics.rebucket(series, "calls", day.start, 30 * MINUTE).orderBy("t").collect()]
    assert half[:3] == [15, 15, None]
    assert tuple(metrics.last_known(series, "calls", 10).first()) == (5, 10)
    spark_line = [r.calls for r in metrics.sparkline(rows(data, METRIC), day, day.start + 88 * MINUTE).orderBy("t").collect()]
    assert spark_line[:6] == [8, 7, 8, 7, 8, None] and len(spark_line) == 96


# ---- orders
LINES = [OrderLine("order placed", r"order placed id=(\w*) store=(\S*) kind=(\w+)", {"order": 1, "store": 2, "kind": 3}, {"kind": ["test"]}),
         OrderLine("placed", r"placed id=(\w+) tenant=(\w+)", {"order": 1, "tenant": 2})]


def test_order_lines(rows):
    logs = rows([(1, "order placed id=A1 store=Shop.COM kind=web", "x"), (2, "order placed id=A2 store=s kind=test", "x"),
                 (3, "order placed id= store=s kind=web", "x"), (4, "placed id=B1 tenant=t9", "x"), (5, None, "placed id=B2 tenant=zz"),
                 (6, "order placed id=null store=s kind=web", "x"), (7, " ", "placed id=B3 tenant=zz"), (None, "placed id=B4 tenant=t", "x")],
                "log_time_ms bigint, msg string, body string")
    got = orders.extract_orders(logs, "svc", LINES, {"t9": "nine.com"}).orderBy("ms").collect()
    assert [(r.store, r.order_id, r.ms) for r in got] == [("shop.com", "A1", 1), ("nine.com", "B1", 4), ("zz", "B2", 5)]


def test_orders_are_counted_once_over_utc_days(rows):
    day = zone_day(date(2026, 11, 9), "PST")                    # 08:00 UTC to 08:00 UTC
    seen = rows([("s", "x", "1", day.start - 60_000), ("s", "x", "1", day.start + HOUR), ("s", "x", "2", day.start + 17 * HOUR),
                 ("s", "x", "2", day.start + 2 * HOUR), ("s", "x", "3", day.end)], "service string, store string, order_id string, ms bigint")
    firsts = orders.zone_first_seen(orders.first_seen_by_utc_day(seen), day).orderBy("first_ms").collect()
    assert [(r.order_id, r.first_ms) for r in firsts] == [("2", day.start + 2 * HOUR)]


# ---- inbound
SNAP = "snapshot_ms bigint, index string, status string, docs_count bigint, creation_ms bigint"


def snapshots(rows, *runs):
    return rows([(at, i, "open", n, made) for at, counts in runs for i, (n, made) in counts.items()], SNAP)


T0 = ms(2026, 11, 17, 6, 5, 3)
A, B, OLD, JG = "a.com-order-2026.11", "b.com-order-2026.11", "c.com-order-2026", "a.com-jg-order-2026"


def test_inbound_delta(rows):
    first = {A: (100, 0), B: (50, 0), JG: (9, 0)}
    second = {A: (173, 0), B: (40, 0), OLD: (31_039, T0 - 30 * DAY), JG: (90, 0), "a.com-order-2026.12": (40, T0 + 60_000)}
    third = {A: (173, 0), B: (40, 0)}
    got = inbound.inbound_delta(snapshots(rows, (T0, first), (T0 + 300_000, second), (T0 + 1_200_000, third))).orderBy("t", "tenant").collect()
    assert [(r.t, r.tenant, r.orders, r.docs, r.span_min) for r in got] == [
        (ms(2026, 11, 17, 6, 5), "_all", 113, 31_292, 5), (ms(2026, 11, 17, 6, 5), "a.com", 113, 213, 5),
        (ms(2026, 11, 17, 6, 10), "_all", 0, 213, 15)]


def test_an_index_missing_from_one_run_is_a_starting_point(rows):
    got = inbound.inbound_delta(snapshots(rows, (T0, {A: (10, 0), B: (1, 0)}), (T0 + 300_000, {B: (1, 0)}), (T0 + 600_000, {A: (99, 0), B: (1, 0)})))
    assert got.filter("tenant = 'a.com'").count() == 0


def test_windows_add_up(rows):
    schema = "t bigint, tenant string, orders bigint, docs bigint, span_min bigint, src string, at bigint"
    old, new = rows([(0, "_all", 10, 5, 2, "live", 1)], schema), rows([(0, "_all", 3, 9, 3, "live", 2), (300_000, "_all", 1, 9, 5, "live", 2)], schema)
    got = {r.t: (r.orders, r.docs, r.span_min) for r in writers.add_windows(old, new).collect()}
    assert got == {0: (13, 9, 5), 300_000: (1, 9, 5)}


def test_index_groups(rows):
    snap = rows([(0, "v.com-order-2026.11.001", "open", 300, 0), (0, "v.com-order-2026.11.002", "open", 24, 0), (0, "v.com-s-order-2026", "open", 5, 0),
                 (0, "foo-order-history-2026", "open", 5, 0), (0, "w.com-order-2026.06", "close", None, 0), (0, ".kibana-order-2026", "open", 1, 0)], SNAP)
    group = inbound.group_order_indexes(snap).first()
    assert (group.tenant, group.total, [p.part for p in group.parts]) == ("v.com", 324, ["001", "002"])
    assert inbound.index_summary(snap).first().asDict() == {"tenants": 1, "rows": 1, "indexes": 2, "orders": 324, "skipped": 1, "unmatched": 1, "closed": 1}


def test_inbound_range_is_empty_where_not_counted(rows):
    data = [(t, s, "_all", 0) for s, upto in ((0, 60), (1, 40)) for t in range(10 * MINUTE, upto * MINUTE, 5 * MINUTE)] + [(20 * MINUTE, 0, "x", 7)]
    windows = rows(data, "t bigint, source int, tenant string, orders bigint")
    assert inbound.as_of(windows, 0, HOUR).first()[0] == 35 * MINUTE
    got = [r.orders for r in inbound.inbound_range(windows, 0, HOUR, "UTC").orderBy("t").collect()]
    assert got == [None, None, 0, 0, 7, 0, 0, 0, None, None, None, None]


def test_backfill_stops_at_live_windows(rows):
    data = rows([("a.com-order-2026", None, 301_000, 5), ("a.com-s-order-2026", 1, 1, 1), ("b.com-order-2026", 1_000_000, 2, 3)],
                "index string, d1 bigint, d2 bigint, d3 bigint")
    live = rows([(900_000, "live"), (600_000, "backfill")], "t bigint, src string")
    got = inbound.inbound_backfill(data, ["d1", "d2", "d3"], 0, HOUR, live).orderBy("t", "tenant").collect()
    assert [(r.t, r.tenant, r.orders) for r in got] == [(0, "_all", 0), (300_000, "_all", 1), (300_000, "a.com", 1), (600_000, "_all", 0)]


def test_week_over_week_cut_off(rows):
    day, before = zone_day(date(2026, 11, 9), "EST"), zone_day(date(2026, 11, 2), "EST")
    data = [(d.start + h * HOUR, "a", "s", 10, 0, 0, None, None, None) for d in (day, before) for h in range(24)]
    got = metrics.week_over_week(rows(data, METRIC), day, before, day.start + 5 * HOUR).first()
    assert (got.calls, got.lw_calls, got.change) == (60, 60, 0.0)
    board = metrics.health_board(rows(data, METRIC), day.start + 6 * HOUR, 360, {"minCalls": 10}).first()
    assert (board.calls, board.lw_calls, board.status) == (60, 60, "green") and day.start - before.start == WEEK


def test_metric_upsert(rows):
    schema = "minute string, api string, stage string, calls bigint"
    got = writers.upsert_newest(rows([("m1", "a", "s", 1), ("m2", "a", "s", 2)], schema), rows([("m2", "a", "s", 9), ("m3", "a", "s", 3)], schema),
                                ["minute", "api", "stage"]).orderBy("minute").collect()
    assert [r.calls for r in got] == [1, 9, 3]


def test_replace_windows(rows):
    schema = "t bigint, n bigint"
    target, fresh = rows([(0, 1), (5, 2), (10, 3)], schema), rows([(5, 7), (6, 8), (11, 9)], schema)
    got = sorted((r.t, r.n) for r in writers.replace_windows(target, fresh, 5, 10).collect())
    assert got == [(0, 1), (5, 7), (6, 8), (10, 3)]


def test_daily_report(rows):
    day, before = zone_day(date(2026, 11, 9)), zone_day(date(2026, 11, 2))
    data = [(day.start, "a", "s", 1500, 15, 12, None, None, None), (before.start, "a", "s", 1000, 0, 0, None, None, None)]
    seen = rows([("svc", "x", str(i), d.start + i) for d, n in ((day, 4), (before, 2)) for i in range(n)],
                "service string, store string, order_id string, first_ms bigint")
    report = metrics.daily_report(rows(data, METRIC), seen, day, before)
    kpi = report["kpi"].first()
    assert (kpi.calls, kpi.lw_calls, kpi.change, kpi.err_5xx_pct) == (1500, 1000, 50.0, 0.8)
    assert tuple(report["peak"].first()) == (day.start, 1500)
    assert [(r.service, r.orders, r.lw_orders, r.change) for r in report["services"].collect()] == [("svc", 4, 2, 100.0)]
    assert [r.kind for r in report["problems"].collect()] == ["5xx"] and report["stores"].count() == 1
