from datetime import datetime, timezone

import pytest

from opslens.functions.times import HOUR, MINUTE
from opslens.operators import grants, health, sessions


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


COUNT = "minute_ms bigint, source string, store string, page string, category string, value string, n bigint"
A, B = ms(2026, 11, 19, 8), ms(2026, 11, 19, 12)
SPO, BOM = "spo.com", "bom.com"


@pytest.fixture
def counts(rows):
    data = []
    for t in range(A, B, 5 * MINUTE):
        data += [(t, "session", "_all", "", "total", "", 0), (t, "cop", "_all", "", "total", "", 0)]
        if t in (A + 2 * HOUR, A + 2 * HOUR + 5 * MINUTE):
            data += [(t, s, st, p, c, v, n) for s, st, p, c, v, n in [
                ("session", SPO, "PDP", "total", "", 100), ("session", SPO, "PDP", "valid", "", 100),
                ("session", SPO, "OC", "total", "", 10), ("session", SPO, "OC", "valid", "", 7),
                ("session", SPO, "OC", "ORDER_LOOKUP_CALL", "", 2), ("session", SPO, "OC", "xyz123", "", 1),
                ("session", SPO, "OC", "variant", "EDD AB / Original", 6), ("session", SPO, "OC", "variant", "EDD AB / Hidden", 4),
                ("session", SPO, "COP", "total", "", 5), ("session", SPO, "COP", "health", "", 1), ("session", SPO, "COP", "valid", "", 4),
                ("cop", SPO, "COP", "total", "", 6), ("cop", SPO, "COP", "valid", "", 4), ("cop", SPO, "COP", "xyz123", "", 2),
                ("session", BOM, "OC", "total", "", 20), ("session", BOM, "OC", "numbers", "", 20),
                ("session", "probe", "COP", "total", "", 9), ("session", "probe", "COP", "health", "", 9)]]
    return rows(data, COUNT)


def test_store_list(counts):
    got = sessions.store_table(counts).collect()
    assert [r.store for r in got] == [SPO, BOM, "probe"]
    spo = got[0]
    assert (spo.entries, spo.oc, spo.oc_bad, spo.oc_bad_pct) == (228, 20, 6, 30.0)
    assert (spo.cop, spo.cop_bad, spo.cop_bad_pct, spo.ab_test) == (12, 4, 33.33, True)
    assert got[1].oc_bad_pct == 100.0 and not got[1].ab_test and got[2].entries == 0
    assert {r.page: r.entries for r in sessions.store_pages(counts).filter(f"store = '{SPO}'").collect()} == {"PDP": 200, "OC": 20, "COP": 8}


def test_one_store(counts):
    checks = [(r.source, r.page, r.total, r.valid, r.bad, r.bad_pct) for r in sessions.store_checks(counts, SPO).collect()]
    assert checks == [("session", "PDP", 200, 200, 0, 0.0), ("session", "COP", 10, 8, 0, 0.0), ("session", "OC", 20, 14, 6, 30.0),
                      ("cop", "COP", 12, 8, 4, 33.33)]
    kinds = [(r.category, r.n) for r in sessions.store_categories(counts, SPO).filter("page = 'OC'").collect()]
    assert kinds == [("valid", 14), ("ORDER_LOOKUP_CALL", 4), ("xyz123", 2)]
    assert [(r.variant, r.n, r.pct) for r in sessions.store_variants(counts, SPO).collect()] == [
        ("EDD AB / Original", 12, 60.0), ("EDD AB / Hidden", 8, 40.0)]


def test_series_are_empty_where_not_counted(counts):
    start = ms(2026, 11, 19, 6)
    got = {(r.series, r.t): r.n for r in sessions.store_series(counts, SPO, start, B, "UTC").collect()}
    assert got[("page PDP", start)] is None and got[("page PDP", A)] == 0 and got[("page PDP", A + 2 * HOUR)] == 100
    assert got[("page COP", A + 2 * HOUR)] == 4 and got[("bad OC", A + 2 * HOUR)] == 3 and got[("variant EDD AB / Hidden", A + 2 * HOUR)] == 4


def test_wide_ranges_use_bigger_buckets_in_the_zone(counts):
    start = ms(2026, 11, 16)
    b = sessions.range_buckets(start, B, "IST")
    assert b.step == HOUR and (b.first + 330 * MINUTE) % HOUR == 0
    got = sessions.store_series(counts, SPO, start, B, "IST").filter("series = 'page PDP'").collect()
    assert sum(r.n or 0 for r in got) == 200 and len(got) == b.count


ENTRY = ("at_ms bigint, source string, index string, page string, session_id string, order_id string, doc_id string, test string, variant string")


def test_counting_entries(rows):
    data = [(A + i, "session", "s.com-session_history-2026.11", "oc", sid, str(i), f"d{i}", "T", "V")
            for i, sid in enumerate(["M1", "M2", None, "probe-x", "zz"])] + [(A + 5 * MINUTE, "cop", "s.com-cop-derrh-2026.11", None, "NA", "", "d9", None, None)]
    entries = rows(data, ENTRY)
    got = {(r.source, r.store, r.page, r.category, r.value): r.n for r in sessions.count_entries(entries, "probe-").collect()}
    base = ("session", "s.com", "OC")
    assert got == {(*base, "total", ""): 5, (*base, "valid", ""): 2, (*base, "missing", ""): 1, (*base, "health", ""): 1, (*base, "other", ""): 1,
                   (*base, "variant", "T / V"): 5, ("cop", "s.com", "(NONE)", "total", ""): 1, ("cop", "s.com", "(NONE)", "NA", ""): 1}
    covered = sessions.with_coverage(sessions.count_entries(entries, "probe-"), A, A + 15 * MINUTE).filter("store = '_all'").orderBy("minute_ms", "source").collect()
    assert [(r.source, r.n) for r in covered] == [("cop", 0), ("session", 5), ("cop", 1), ("session", 0), ("cop", 0), ("session", 0)]
    bad = sessions.bad_ids(entries, "probe-").orderBy("at_ms").collect()
    assert [(r.session_id, r.category, r.order_id) for r in bad] == [("", "missing", "2"), ("zz", "other", "4"), ("NA", "NA", "")]


def test_id_values(rows):
    ids = rows([("s", "session", "OC", "xyz123", "xyz123", 3, "a"), ("s", "session", "OC", "NA", "NA", 2, "b"), ("s", "session", "OC", "NA", "NA", 1, "c"),
                ("s", "cop", "COP", "NA", "NA", 1, "d")], "store string, source string, page string, category string, session_id string, at_ms bigint, doc_id string")
    picked = sessions.id_list(ids, "s", "session", "oc")
    assert [tuple(r) for r in sessions.id_values(picked).collect()] == [("NA", 2, 3), ("xyz123", 1, 3)]
    assert [r.doc_id for r in sessions.id_page(picked, 2).collect()] == ["a", "b"]
    assert [r.doc_id for r in sessions.id_list(ids, "s", "cop", None, "bad").collect()] == ["d"]


# ---- inventory
@pytest.fixture
def snap(rows):
    return {
        "clusters": rows([(c,) for c in ("alpha-1", "alpha-2", "routing", "batch", "btp")], "cluster string"),
        "services": rows([("alpha-2", "estimate", "ACTIVE", 3, 2, "IN_PROGRESS", None), ("routing", "oms", "ACTIVE", 1, 0, "COMPLETED", "tg-routing"),
                          ("btp", "hook", "ACTIVE", 1, 1, "COMPLETED", "webhook"), ("batch", "idle", "ACTIVE", 0, 0, None, "gone-group")],
                         "cluster string, service string, status string, desired int, running int, rollout string, tg string"),
        "instances": rows([("alpha-1", "i-1", "ACTIVE", True), ("alpha-1", "i-2", "ACTIVE", True), ("alpha-2", "i-3", "ACTIVE", True)],
                          "cluster string, instance_id string, status string, agent_connected boolean"),
        "targets": rows([("tg-alpha-1", "i-1", "healthy", None), ("tg-alpha-2", "i-3", "healthy", None), ("tg-alpha-2", "i-9", "unhealthy", "Failed"),
                         ("tg-routing", "i-7", "unhealthy", "Failed"), ("webhook", "i-8", "healthy", None), ("jenkins", "i-0", "unused", None)],
                        "tg string, target_id string, state string, reason string"),
        "groups": rows([(g, None) for g in ("tg-alpha-1", "tg-alpha-2", "tg-routing", "webhook", "jenkins", "btp")], "tg string, error string"),
    }


def test_links_and_status(snap):
    linked = health.links(snap)
    assert {(r.cluster, r.tg): r.linked_by for r in linked.collect()} == {
        ("alpha-1", "tg-alpha-1"): ["instances", "name"], ("alpha-2", "tg-alpha-2"): ["instances", "name"],
        ("routing", "tg-routing"): ["name", "service"], ("btp", "webhook"): ["service"], ("btp", "btp"): ["name"]}
    assert [r.tg for r in health.unlinked_groups(snap, linked).collect()] == ["jenkins"]
    behind = {r.instance_id: r.behind_balancer for r in health.instances_behind(snap, linked).collect()}
    assert behind == {"i-1": True, "i-2": False, "i-3": True}
    got = health.cluster_health(snap, linked).collect()
    assert [(r.cluster, r.status) for r in got] == [("routing", "down"), ("alpha-2", "degraded"), ("alpha-1", "healthy"), ("btp", "healthy"), ("batch", "none")]
    assert (got[1].healthy_targets, got[1].targets, got[1].bad_targets) == (1, 2, 1)
    assert health.health_summary(health.cluster_health(snap)).first().asDict() == {
        "clusters": 5, "with_balancer": 4, "without_balancer": 1, "down": 1, "degraded": 1, "healthy": 2, "unhealthy_targets": 2, "services_below_desired": 2}


def test_recent_average_falls_back_to_the_last_two_points(rows):
    now = 100 * MINUTE
    points = rows([(c, "cpu", t * MINUTE, v) for c, t, v in [("a", 95, 10.0), ("a", 91, 20.0), ("b", 88, 50.0), ("b", 80, 70.0), ("b", 79, 1.0), ("c", 60, 9.0)]],
                  "cluster string, metric string, t_ms bigint, value double")
    got = {r.cluster: (r.avg, r.peak) for r in health.recent_average(points, now, 10).collect()}
    assert got == {"a": (15.0, 20.0), "b": (60.0, 70.0)}
    series = health.utilisation(points, 1).filter("cluster = 'a'").first()
    assert (series["now"], series.avg, series["max"]) == (10.0, 15.0, 20.0) and health.period_ms(24) == 24 * MINUTE


def test_grants(rows):
    g = rows([("ann", "*", "view"), ("ann", "c2", "none"), ("bob", "c2", "view"), ("cy", "*", "none"), ("cy", "c1", "view")],
             "user string, cluster string, level string")
    pairs = rows([(u, c) for u in ("ann", "bob", "cy") for c in ("c1", "c2")], "user string, cluster string")
    assert sorted((r.user, r.cluster) for r in grants.access_levels(pairs, g).filter("level = 'view'").collect()) == [("ann", "c1"), ("bob", "c2"), ("cy", "c1")]
    clusters = rows([("c1",), ("c2",), ("c3",)], "cluster string")
    assert {r.cluster: r.users for r in grants.cluster_readers(clusters, g).collect()} == {"c1": ["ann", "cy"], "c2": ["bob"], "c3": ["ann"]}
    seen = rows([("c1",), ("c2",), (None,)], "cluster string")
    assert {u: sorted(r[0] for r in grants.visible(seen, u, g).collect()) for u in ("ann", "bob", "cy", "dee")} == {
        "ann": ["c1"], "bob": ["c2"], "cy": ["c1"], "dee": []}
