import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from opslens.functions.times import HOUR, MINUTE
from opslens.operators import access, rules, state
from opslens.operators.lb import RequestQuery
from opslens.operators.mutes import Mute, active, mute_subjects, muted_paths, muted_signatures
from test_balancers import REQ, request

FINDING = ("rule_id string, subject string, at_ms bigint, bad boolean, value double, level string, warning double, critical double, h double, "
           "hold int, muted_by array<string>, muted_level string, confirm int, for_minutes int")


def values(rows, series, confirm=1, subject="x", step=5, warning=70.0, critical=80.0):
    return rows([("r", subject, i * step * MINUTE + 1, v >= warning, float(v), None, warning, critical, 2.0, 0, None, None, confirm, 0)
                 for i, v in enumerate(series)], FINDING)


def events(df, repeat=None):
    got = state.transitions(df, None, {"warning": 0, "critical": 0} if repeat is None else repeat).orderBy("at_ms", "subject").collect()
    return [((r.at_ms - 1) // MINUTE, r.event, r.level) for r in got]


@pytest.mark.parametrize("series, confirm, repeat, want", [
    ([95, 50, 95, 50], 2, None, []),
    ([75, 76, 85, 86, 79, 77, 69, 68], 2, None, [(5, "firing", "warning"), (15, "escalated", "critical"), (25, "lowered", "warning"), (35, "resolved", "warning")]),
    ([71, 69, 71, 69, 71, 60], 1, None, [(0, "firing", "warning"), (25, "resolved", "warning")]),
    ([90] * 7, 1, {"warning": 60, "critical": 15}, [(0, "firing", "critical"), (15, "repeat", "critical"), (30, "repeat", "critical")]),
    ([75] * 14, 1, {"warning": 60, "critical": 15}, [(0, "firing", "warning"), (60, "repeat", "warning")])])
def test_levels_hysteresis_and_confirmation(rows, series, confirm, repeat, want):
    assert events(values(rows, series, confirm), repeat) == want


def finding(at, bad=True, level="warning", hold=0, muted=None, confirm=2, subject="s", for_minutes=0, muted_level=None):
    return ("r", subject, at * MINUTE + 1, bad, None, level, None, None, None, hold, muted, muted_level, confirm, for_minutes)


def test_hold_and_waiting_time(rows):
    deploying = [finding(t, hold=10) for t in range(0, 14, 2)]
    assert events(rows(deploying, FINDING)) == [(10, "firing", "warning")]
    patient = [finding(t, for_minutes=4, confirm=1) for t in range(0, 8, 2)]
    assert events(rows(patient, FINDING)) == [(4, "firing", "warning")]


def test_a_subject_no_longer_reported_is_resolved(rows):
    data = [finding(t, confirm=1, subject="gone") for t in (0, 2)] + [finding(t, confirm=1, subject="stays") for t in (0, 2, 4, 6)]
    got = state.transitions(rows(data, FINDING), None, {}).orderBy("at_ms", "subject").collect()
    assert [(r.subject, r.event, (r.at_ms - 1) // MINUTE) for r in got] == [("gone", "firing", 0), ("stays", "firing", 0), ("gone", "resolved", 4)]


def test_muted_subjects(rows):
    # waiting under a mute counts the same checks, tells once, and starts over without the mute
    data = [finding(0, False, muted=["A"]), finding(2, False, muted=["A"]), finding(4, False, muted=["A"]), finding(6), finding(8)]
    assert events(rows(data, FINDING)) == [(2, "muted", "warning"), (8, "firing", "warning")]
    # a firing subject stops without an OK; checks already passed while pending count
    data = [finding(0), finding(2), finding(4, False, muted=["B"]), finding(6, False, level=None)]
    assert events(rows(data, FINDING)) == [(2, "firing", "warning"), (4, "muted", "warning")]
    data = [finding(0), finding(2, False, muted=["C"], muted_level="critical")]
    assert events(rows(data, FINDING)) == [(2, "muted", "critical")]


def test_reminder_after_a_snooze(rows):
    found = rows([finding(t, confirm=1) for t in range(0, 20, 5)], FINDING)
    snoozes = rows([("r", "s", 9 * MINUTE)], "rule_id string, subject string, until bigint")
    marked = state.remind_after_snooze(found, snoozes)
    assert events(marked, {}) == [(0, "firing", "warning"), (10, "repeat", "warning")]


def test_snoozes(rows):
    log = rows([("r", "a", 5, "repeat", "warning"), ("r", "a", 15, "repeat", "warning"), ("r", "b", 5, "firing", "warning"), ("r", "b", 6, "resolved", "warning"),
                ("r", "c", 5, "repeat", "warning")], "rule_id string, subject string, at_ms bigint, event string, level string")
    snoozes = rows([("r", "a", 10), ("r", "b", None)], "rule_id string, subject string, until bigint")
    got = sorted((r.subject, r.at_ms, r.snoozed) for r in state.apply_snoozes(log, snoozes).collect())
    assert got == [("a", 15, False), ("b", 5, True), ("b", 6, False), ("c", 5, False)]


def test_lines():
    assert rules.lb_lines(5, None, True) == {"warning": 5, "critical": 10, "h": 1.0}
    assert rules.lb_lines(60, 0, True)["critical"] == 100.0 and rules.lb_lines(20, None, True)["h"] == 2
    assert rules.lb_lines(100, None, False) == {"warning": 100, "critical": 200, "h": 10} and rules.lb_lines(3, 1, False)["critical"] == 3
    assert rules.split_codes(["5xx", "503", "404", "404"]) == (["5xx"], [404])


NOW = 100 * HOUR
END = NOW - 10 * MINUTE


@pytest.fixture
def traffic(rows):
    """An hour: tg-a fails on two paths, tg-b is fine; the day before tg-a had 10 % errors."""
    data = [request(END - 30 * MINUTE + i, 500, tg="tg-a", group="/pay" if i % 2 else "/info", method="POST") for i in range(20)]
    data += [request(END - 30 * MINUTE + 100 + i, 200, tg="tg-a") for i in range(80)]
    data += [request(END - 30 * MINUTE + 300 + i, 200, tg="tg-b") for i in range(60)]
    data += [request(END - 10 * HOUR + i, 500 if i % 10 == 0 else 200, tg="tg-a") for i in range(100)]
    return rows(data, REQ)


def test_error_rates(traffic):
    minutes = access.minute_rollup(traffic)
    got = {r.subject: (r.bad, r.value, r.warning) for r in rules.lb_errors(minutes, "r", NOW, 60, 15).collect()}
    assert got == {"tg-a": (True, 20.0, 15.0), "tg-b": (False, 0.0, None)}
    quiet = rules.lb_errors(minutes, "r", NOW, 60, 15, vs_usual=3).filter("subject = 'tg-a'").first()
    assert (quiet.bad, quiet.warning) == (False, None)
    assert rules.lb_errors(minutes, "r", NOW, 60, 15, vs_usual=2).filter("bad").count() == 1
    counts = rules.lb_status(minutes, "r", NOW, 60, ["500", "5xx"], 20).filter("subject = 'tg-a'").first()
    assert (counts.bad, counts.value, counts.critical) == (True, 20.0, 40.0)
    slow = {r.subject: r.bad for r in rules.lb_latency(minutes, "r", NOW, 60, 100, 61).collect()}
    assert slow == {"tg-a": True, "tg-b": False}


def test_muted_paths_are_taken_out_and_judged_again(traffic):
    minutes = access.minute_rollup(traffic)
    window = RequestQuery(END - HOUR, END)
    from opslens.operators.lb import PATHS, path_code_counts
    paths = path_code_counts(access.path_rollup(traffic).filter(window.condition(PATHS)))
    one = [Mute("P", target_groups=["tg-a"], paths=[("POST", "/pay")])]
    assert tuple(muted_paths(paths, one, "lb_errors", ["5xx"]).first()) == ("tg-a", 10, 10, ["P"])
    part = rules.lb_errors(minutes, "r", NOW, 60, 5, mutes=one, path_counts=paths).filter("subject = 'tg-a'").first()
    assert (part.bad, part.value, part.muted_by) == (True, 11.11, [])
    both = one + [Mute("Q", paths=[(None, "/in*")], codes=["5xx"])]
    gone = rules.lb_errors(minutes, "r", NOW, 60, 5, mutes=both, path_counts=paths).filter("subject = 'tg-a'").first()
    assert (gone.bad, gone.muted_by, gone.muted_level, gone.warning) == (False, ["P", "Q"], "critical", None)


def test_muted_signatures(rows, traffic):
    from opslens.operators.lb import path_code_counts
    paths = path_code_counts(access.path_rollup(traffic))
    lines = rows([("a", END - 5, "boom in cart"), ("a", END + MINUTE, "no such index"), ("b", END - 5, "other")], "cluster string, log_time_ms bigint, msg string")
    def ids(*mutes):
        got = muted_signatures(paths, lines, list(mutes), "lb_errors", ["5xx"], END - HOUR, END).collect()
        return {r.tg: r.signature_ids for r in got}
    first, second = Mute("S", clusters=["a"], signatures=["BOOM"]), Mute("T", signatures=["such index", "other"], target_groups=["tg-*"])
    assert ids(first) == {} and ids(first, second) == {"tg-a": ["S", "T"], "tg-b": ["T"]}
    elsewhere = Mute("U", clusters=["a"], signatures=["boom", "index"], paths=[(None, "/pay")])
    assert ids(elsewhere) == {}                                    # requests also fail on a path it does not name
    assert ids(elsewhere, Mute("V", paths=[(None, "/info")]), Mute("W", paths=[(None, "/x")])) == {"tg-a": ["U"]}


def test_log_errors_leave_out_muted_lines(rows):
    logs = rows([("c", NOW - i, "error", "known thing" if i % 2 else "new") for i in range(10)] + [("d", NOW, "error", "known")],
                "cluster string, log_time_ms bigint, level string, msg string")
    mutes = [Mute("K", clusters=["c"], signatures=["KNOWN"])]
    got = {r.subject: (r.bad, r.value, r.muted_by) for r in rules.log_errors(logs, "r", NOW, 5, 6, mutes=mutes).collect()}
    assert got == {"c": (False, 5.0, ["K"]), "d": (False, 1.0, [])}


def test_stale_logs(rows):
    hour = 1_791_352_800_000
    files = rows([("a", hour, f"{hour // 1000 - 600}-x.parquet"), ("b", hour - HOUR, "part-0.parquet"), ("c", hour - 9 * HOUR, "1-old.parquet")],
                 "cluster string, hour_ms bigint, name string")
    clusters = rows([("a",), ("b",), ("c",)], "cluster string")
    got = {r.subject: (r.bad, r.value) for r in rules.logs_stale(clusters, files, "r", hour + 20 * MINUTE, 30).collect()}
    assert got == {"a": (True, 30.0), "b": (False, 20.0), "c": (True, None)}


SERVICE = "at_ms bigint, cluster string, status string, desired int, running int"
INSTANCE = "at_ms bigint, cluster string, instance_id string, status string, agent_connected boolean"


def test_instances_that_left(rows):
    at = [i * 2 * MINUTE for i in range(6)]
    history = rows([(t, "c", "i-1", "ACTIVE", True) for t in at] + [(t, "c", "i-2", "ACTIVE", True) for t in at[:2]]
                   + [(t, "c", "i-3", "ACTIVE", False) for t in at[:1]] + [(at[5], "c", "i-3", "DRAINING", False)], INSTANCE)
    running = [2, 2, 1, 1, 2, 1]
    services = rows([(t, "c", "ACTIVE", 2, n) for t, n in zip(at, running)], SERVICE)
    got = sorted((r.subject[4:], r.at_ms // MINUTE, r.bad) for r in rules.ecs_instances(history, services, "r").collect() if "i-1" not in r.subject)
    assert got == [("i-2", 0, False), ("i-2", 2, False), ("i-2", 4, True), ("i-2", 6, True), ("i-2", 8, False),
                   ("i-3", 0, True), ("i-3", 2, False), ("i-3", 10, False)]


def test_mute_matching(rows):
    m = Mute("A", target_groups=["tg-alpha-*"], paths=[("POST", "/x/<store>/info"), (None, "/y/*")], codes=["4xx"])
    df = rows([("tg-alpha-11", "post", "/x/acme/info"), ("tg-beta", "GET", "/x/a/info"), ("tg-alpha-1", "GET", "/y/a/b")], "tg string, m string, p string")
    got = df.select(m.target_group(F.col("tg")), m.path(F.col("m"), F.col("p")), m.cluster(F.expr("substr(tg, 4)"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (True, True, True)]
    assert m.kind == "path" and m.about_codes(["400"]) and not m.about_codes(["5xx"])
    assert active([m, Mute("B", subjects=["x"], rules=["ecs_tasks"]), Mute("C", enabled=False)], "subject", "lb_errors") == []


def test_subject_mutes(rows):
    found = rows([("r", "tg-a", True, "warning", "a"), ("r", "tg-b", True, "critical", "b"), ("r", "tg-c", False, None, "c")],
                 "rule_id string, subject string, bad boolean, level string, cluster string").withColumns({
                     "muted_by": F.expr("CAST(array() AS ARRAY<STRING>)"), "muted_level": F.lit(None).cast("string"),
                     **{c: F.lit(None).cast("double") for c in ("warning", "critical", "h")}})
    mutes = [Mute("K", clusters=["B", "c"]), Mute("L", subjects=["tg-b"]), Mute("N", rules=["ecs_tasks"], subjects=["*"])]
    firing = rows([("r", "tg-c")], "rule_id string, subject string")
    got = {r.subject: (r.bad, r.muted_by, r.muted_level) for r in mute_subjects(found, mutes, "lb_errors", firing=firing).collect()}
    assert got == {"tg-a": (True, [], None), "tg-b": (False, ["K", "L"], "critical"), "tg-c": (False, ["K"], "warning")}


def walked(found, repeat):
    """Events of whole histories by one tracker a subject."""
    out = []
    for subject in sorted({f[1] for f in found}):
        tracker = state.Tracker()
        for f in sorted((f for f in found if f[1] == subject), key=lambda f: (f[2], not f[-1])):
            row = SimpleNamespace(**dict(zip([*[c.split()[0] for c in FINDING.split(", ")], "remind", "gone"], f, strict=True)), base_level="warning")
            if event := tracker.see(row, repeat):
                out.append((subject, row.at_ms, *event))
    return out


def test_episodes_give_what_one_tracker_a_subject_gives(rows):
    r, repeat = random.Random(6), {"warning": 20, "critical": 15}
    found = []
    for k in range(30):
        by_lines, confirm = k % 2 == 0, r.choice([1, 2, 3])
        for i in range(60):
            value = None if r.random() < 0.05 else float(r.choice([50, 66, 68, 69, 70, 75, 78, 79, 80, 90]))
            muted = ["M"] if r.random() < 0.15 else ([] if r.random() < 0.5 else None)
            lines = (70.0, 80.0, 2.0) if by_lines else (None, None, None)
            found.append(("r", f"s{k:02}", i * 5 * MINUTE, r.random() < 0.6, value, None if by_lines else r.choice([None, "warning", "critical"]), *lines, r.choice([0, 0, 7]),
                          muted, r.choice([None, "critical"]), confirm, r.choice([0, 6]), r.random() < 0.1, r.random() < 0.05))
    df = rows(found, FINDING + ", remind boolean, gone boolean")
    cut = state.episodes(state.complete(df))
    assert cut.count() < len(found) and cut.select("subject", "episode").distinct().count() > 100
    got = state.transitions(df, None, repeat).collect()
    assert sorted((x.subject, x.at_ms, x.event, x.level) for x in got) == sorted(walked(found, repeat))
    assert {x.event for x in got} == {"firing", "escalated", "lowered", "repeat", "resolved", "muted"}


def test_missing_instances_are_remembered_for_a_day(rows):
    history, services = checks_of_instances(rows)
    got = {(x.subject, (x.at_ms - BASE) // HOUR): x.bad for x in rules.ecs_instances(history, services, "r").collect()}
    assert [got.get(("c / b", h)) for h in range(2, 11)] == [True, True, True, False, None, None, None, False, False]
    away = [got.get(("d / x", h)) for h in range(2, 40)]
    assert away == [True] * 24 + [False] + [None] * 13
    assert got["c / lost", 0] is True and got["c / a", 0] is False


BASE = 1000 * HOUR


def checks_of_instances(rows):
    """Two clusters checked every hour: c is short for a while, d for good."""
    there = [(h, "c", "a", "ACTIVE", True) for h in range(12)] + [(h, "c", "b", "ACTIVE", True) for h in (0, 1, 9)] + [(0, "c", "lost", "ACTIVE", False)]
    there += [(h, "d", "x", "ACTIVE", True) for h in (0, 1)] + [(h, "d", "y", "DRAINING", True) for h in range(40)]
    services = [(h, "c", "ACTIVE", 2, 1 if 1 < h < 5 else 2) for h in range(12)] + [(h, "d", "ACTIVE", 2, 1) for h in range(40)]
    return (rows([(BASE + h * HOUR, *x) for h, *x in there], "at_ms bigint, cluster string, instance_id string, status string, agent_connected boolean"),
            rows([(BASE + h * HOUR, *x) for h, *x in services], "at_ms bigint, cluster string, status string, desired int, running int"))
