import gzip

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from opslens.functions import patterns as P
from opslens.operators import access, lb
from opslens.operators.lb import Access, RequestQuery, RequestTables
from opslens.sources import readers

#: a websocket upgrade with quotes in the agent, a refused plain request, and a line cut short
LINES = [
    " ".join(["wss", "2025-02-03T23:59:59.040000Z", "app/front-7/77aa", "203.0.113.44:40122", "172.31.9.5:8443", "0.002", "12.75", "0.001", "101", "101", "733", "90210",
              '"GET wss://live.shop.test:443/feed/ws/550?room=blue#top HTTP/1.1"', r'"Agent \"Quoted\" 9 (beta)"', "TLS_AES_256_GCM_SHA384", "TLSv1.3",
              "arn:aws:elasticloadbalancing:eu-central-1:000011112222:targetgroup/tg-feed/9f9f", '"Root=1-feed"', '"live.shop.test"', '"arn:cert"', "3",
              "2025-02-03T23:59:46.200000Z", '"waf,forward"', '"-"', '"-"', '"172.31.9.5:8443"', '"101"', '"-"', '"-"', "TID_ws"]),
    " ".join(["http", "2025-02-04T00:00:00.5Z", "app/front-7/77aa", "[2001:db8::9]:51000", "-", "-1", "-1", "-1", "460", "-", "0", "0",
              '"- http://live.shop.test:80- -"', '"-"', "-", "-", "-", '"-"', '"-"', '"-"', "-", "2025-02-04T00:00:00.4Z", '"-"', '"-"', '"-"', '"-"', '"-"', '"Ambiguous"',
              '"UndefinedContentLengthSemantics"', "TID_no", '"-"', '"-"', '"-"', "-", '"later"']),
    "", "cut short",
]


def test_lines_are_converted(spark, tmp_path):
    with gzip.open(tmp_path / "x.log.gz", "wt") as out:
        out.write("\n".join(LINES) + "\n")
    lines = readers.read_access_lines(spark, str(tmp_path))
    assert sorted(r.raw for r in lines.collect()) == sorted(x for x in LINES if x)
    rows = access.parse_requests(lines)
    assert rows.columns == P.REQUEST_COLUMNS
    by = {r.raw: r.asDict() for r in rows.collect()}

    def check(line, **want):
        assert {k: by[line][k] for k in want} == want
    check(LINES[0], trace_id="Root=1-feed", type="wss", ts_ms=1738627199040, lb="front-7", tg="tg-feed", cluster="feed", domain="live.shop.test", method="GET", protocol="HTTP/1.1",
          path="/feed/ws/550", path_group="/feed/ws/<n>", query="room=blue", elb_code=101, tgt_code=101, client_ip="203.0.113.44", client_port=40122,
          target="172.31.9.5:8443", tgt_t=12.75, req_t=0.002, rx=733, tx=90210, user_agent=r"Agent \"Quoted\" 9 (beta)", ssl_protocol="TLSv1.3",
          rule_priority="3", actions="waf,forward", error_reason=None)
    check(LINES[1], elb_code=460, tg=None, cluster=None, tgt_code=None, tgt_t=None, target=None, user_agent=None, rule_priority=None, trace_id=None,
          client_ip="[2001:db8::9]", client_port=51000, classification="Ambiguous", ts_ms=1738627200500)
    check(LINES[3], type="cut", ts_ms=None, lb=None, elb_code=None)


def test_access_keys(rows):
    names = ["in/2025/000011112222_elasticloadbalancing_eu-central-1_app.front-7.77aa_20250204T0000Z_172.31.0.9_q1w2.log.gz", "in/2025/notes.log.gz"]
    (key,) = access.parse_access_key(rows([(n,) for n in names], "path string")).collect()
    assert (key.account, key.region, key.lb, key.end_ms) == ("000011112222", "eu-central-1", "front-7", 1738627200000)
    assert key.hour_ms == key.end_ms - 3_600_000  # a file that ends at midnight is of the last hour of the day


REQ = "ts_ms bigint, lb string, tg string, cluster string, domain string, method string, path string, path_group string, " \
      "elb_code smallint, tgt_code smallint, client_ip string, target string, tgt_t double, trace_id string, raw string"
H, M, DAY = 3_600_000, 60_000, 86_400_000


def request(ts, code, tg="tg-a", answered=True, t=0.1, lb_="lb1", method="GET", group="/x", domain="d"):
    return (ts, lb_, tg, tg and tg.removeprefix("tg-"), domain, method, group, group, code, code if answered else None,
            "10.0.0.1", "1.1.1.1:80", t if answered else None, f"t{ts}", f"raw {method} {group} {code}")


@pytest.fixture
def tables(rows):
    data = [request(1000 + i * 600_000, c, **k) for i, (c, k) in enumerate([
        (200, {}), (200, {"t": 0.3}), (500, {}), (503, {"answered": False}), (404, {"method": "POST"}), (600, {}),
        (502, {"tg": None, "answered": False}), (500, {"group": "/y"}), (500, {"group": "/y"}), (201, {"tg": "tg-b", "lb_": "lb2"})])]
    requests = rows(data, REQ)
    return RequestTables(requests, access.minute_rollup(requests), access.path_rollup(requests))


def test_totals(tables):
    query = RequestQuery(0, 10 * H)
    got = lb.status_totals(query.minutes(tables)).first().asDict()
    assert {k: got[k] for k in ("requests", "c2xx", "c3xx", "c4xx", "c5xx", "other", "s5xx_app", "s5xx_lb")} == {
        "requests": 10, "c2xx": 3, "c3xx": 0, "c4xx": 1, "c5xx": 5, "other": 1, "s5xx_app": 4, "s5xx_lb": 2}
    assert got["avg"] == pytest.approx(1.0 / 8)


def test_totals_of_nothing(tables):
    got = lb.status_totals(RequestQuery(100 * H, 101 * H).minutes(tables)).first()
    assert got.requests == 0 and got.p95 is None and got.avg is None


def test_target_groups_keep_the_missing_one(tables):
    query = RequestQuery(0, 10 * H)
    got = lb.target_group_table(query.minutes(tables), query.paths(tables)).collect()
    assert [r.tg for r in got] == ["tg-a", None, "tg-b"]
    assert (got[0].s5xx, got[0].s4xx, got[0].error_path, got[0].error_code, got[0].error_count) == (5, 1, "/x", 600, 3)
    assert (got[1].error_code, got[1].error_count, got[1].p95) == (502, 1, None) and got[2].error_path is None


def test_paths(tables):
    got = lb.path_table(RequestQuery(0, 10 * H).paths(tables), "errors", 2).collect()
    assert [(r.method, r.path_group, r.requests, r.groups) for r in got] == [("GET", "/x", 7, 3), ("GET", "/y", 2, 3)]
    assert got[0].tgs == ["tg-a", "tg-b"] and got[1].top_code == 500


def test_routing():
    assert RequestQuery(0, 1).level() == "minute" and RequestQuery(0, 1, domains=["d"]).level() == "minute"
    assert RequestQuery(0, 1, methods=["GET"]).level() == "paths" and RequestQuery(0, 1, path_group="/").level() == "paths"
    assert RequestQuery(0, 1, methods=["GET"], domains=["d"]).level() == "rows"
    for row_only in ({"path": "x"}, {"client": "1"}, {"target": "1"}, {"words": "x"}, {"min_target_seconds": 0.0}):
        assert RequestQuery(0, 1, **row_only).level() == "rows"


def test_roll_ups_and_rows_agree(tables):
    for kind in ({}, {"status_classes": ["5xx", "other"]}, {"target_groups": ["-", "tg-b"]}, {"methods": ["post"]},
                 {"source": "lb"}, {"status_codes": [500]}):
        query = RequestQuery(0, 10 * H, **kind)
        rows = tables.requests.filter(query.condition(lb.ROWS)).count()
        assert (query.minutes(tables).agg(F.sum("n")).first()[0] or 0) == rows
        assert (query.paths(tables).agg(F.sum("n")).first()[0] or 0) == rows


def test_pages_are_slices_of_the_whole_order(tables):
    query = RequestQuery(500, 95 * 60_000 + 7)
    everything = [r.trace_id for r in tables.requests.filter(query.condition(lb.ROWS)).orderBy(F.desc("ts_ms"), "trace_id").collect()]
    for offset in range(0, len(everything) + 2, 3):
        got = [r.trace_id for r in lb.request_page(query, tables, 3, offset).collect()]
        assert got == everything[offset:offset + 3]
    oldest = [r.trace_id for r in lb.request_page(query, tables, 4, 2, descending=False).collect()]
    assert oldest == everything[::-1][2:6]


def test_slowest(tables):
    got = [r.tgt_t for r in lb.slowest(RequestQuery(0, 10 * H), tables, 3).collect()]
    assert got == [0.3, 0.1, 0.1]
    assert len(lb.slowest(RequestQuery(0, 10 * H), tables, 20).collect()) == 8


def test_access(rows):
    clusters = rows([("a",), ("b",), ("c",), (None,)], "cluster string")

    def seen(rules):
        return [r[0] for r in clusters.filter(Access(rules).condition(F.col("cluster"))).collect()]
    assert seen({"*": "view", "b": "none"}) == ["a", "c"] and seen({"a": "view", "b": "none"}) == ["a"] and seen({"*": "none"}) == []


def test_tuples(rows):
    assert tuples(rows([(1,)], "a int")) == [(1,)]


def test_spans_cover_a_range_once_in_the_longest_steps():
    assert lb.spans(0, 2 * DAY, None) == [(DAY, 0, 2 * DAY)]
    assert lb.spans(0, 2 * DAY, 3 * H) == [(H, 0, 2 * DAY)]
    assert lb.spans(5 * M, 50 * M, None) == [(M, 5 * M, 50 * M)] and lb.spans(M, M, None) == []
    found = lb.spans(DAY - H - M, 2 * DAY + H + M, None)
    assert found == [(M, DAY - H - M, DAY - H), (H, DAY - H, DAY), (DAY, DAY, 2 * DAY), (H, 2 * DAY, 2 * DAY + H), (M, 2 * DAY + H, 2 * DAY + H + M)]
    for start in range(0, 3 * DAY, 7 * H + 13 * M):
        for length in (M, 59 * M, 3 * H, 25 * H, 3 * DAY + M):
            for step in (None, M, 5 * M, H, 3 * H, DAY, 36 * H):
                pieces = lb.spans(start, start + length, step)
                assert [p[1] for p in pieces] + [start + length] == [start] + [p[2] for p in pieces] and len(pieces) <= 5
                assert all(a % g == 0 and b % g == 0 and (step is None or g == M or step % g == 0) for g, a, b in pieces)


def test_longer_steps_give_the_same_rows_whatever_the_range(spark, rows):
    data = [(i * 37 * M + i, f"lb-{i % 3}", None if i % 5 == 0 else f"tg-c{i % 4}", 200 + i % 3 * 150) for i in range(300)]
    made = rows(data, "ts_ms bigint, lb string, tg string, elb_code smallint").selectExpr(
        "*", "CAST(NULL AS STRING) AS cluster", "'d' AS domain", "'GET' AS method", "'/p' AS path_group", "elb_code AS tgt_code", "ts_ms % 977 / 100D AS tgt_t").persist()
    minutes, paths = access.minute_rollup(made).persist(), access.path_rollup(made).persist()

    def steps(rollup):
        hours = access.coarser(rollup.filter("lb <> 'lb-2'"), H)
        return lb.LongSteps(hours, access.coarser(hours, DAY), rollup.filter("lb = 'lb-2'"))
    plain = RequestTables(made, minutes, paths)
    long = RequestTables(made, minutes, paths, None, steps(minutes), steps(paths))
    by_path = {"methods": ["GET"], "target_groups": ["-", "tg-c1"]}
    for start, end, step, filters in ((3 * H + M, 5 * DAY + 7, None, {}), (3 * H + M, 5 * DAY + 7, 2 * H, by_path), (DAY + 10 * M, DAY + 40 * M, None, by_path),
                                      (2 * DAY, 3 * DAY - 1, DAY, {}), (9 * DAY, 10 * DAY, None, {})):
        query = RequestQuery(start, end, **filters)
        bucket = F.expr("minute_ms * 0") if step is None else F.expr(f"minute_ms div {step}")
        want, got = (sorted(map(tuple, q.groupBy(bucket, "lb", "tg", "elb_code", "lat_bin").agg(F.sum("n")).collect()), key=repr)
                     for q in (query.minutes(plain), query.minutes(long, step)))
        assert want == got
    query = RequestQuery(3 * H + M, 5 * DAY + 7)
    assert sorted(map(tuple, lb.hour_counts(query, plain).collect())) == sorted(map(tuple, lb.hour_counts(query, long).collect()))
    pages = [lb.summary(query, t, 3 * H) for t in (plain, long)]
    for part in ("totals", "buckets", "target_groups"):
        shown = [page[part].select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in page[part].dtypes]) for page in pages]
        assert sorted(map(repr, shown[0].collect())) == sorted(map(repr, shown[1].collect()))
    for df in (made, minutes, paths, *[page["cells"] for page in pages]):
        df.unpersist()
