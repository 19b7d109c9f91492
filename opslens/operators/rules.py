"""Alert rules as queries: each returns findings, one row per subject.

Finding columns: rule_id, at_ms, subject, bad, value, level, warning, critical, h, hold, cluster, message,
muted_by, muted_level. With lines (warning, critical, h) the level follows the value.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions import web
from ..functions.figures import pct, sum_when
from ..functions.text import contains_text, matches_any_glob, true_or_false
from ..functions.times import HOUR, MINUTE
from . import errors, health, lb
from .mutes import NO_IDS, Mute, _any, active, hit_ids, mute, muted_paths, muted_signatures
from .search import LogQuery

FINDING = ["rule_id", "at_ms", "subject", "bad", "value", "level", "warning", "critical", "h", "hold", "cluster",
           "message", "muted_by", "muted_level"]


def findings(rows: DataFrame, rule_id: str, at_ms: int | Column, subject: Column, bad: Column, value: Column | None = None,
             level: Column | None = None, lines: Mapping[str, Column] | None = None, hold: Column | None = None,
             cluster: Column | None = None, message: Column | None = None, muted_by: Column | None = None,
             muted_level: Column | None = None) -> DataFrame:
    none = F.lit(None)
    lines = lines or {}
    given = {"rule_id": F.lit(rule_id), "at_ms": (F.lit(at_ms) if isinstance(at_ms, int) else at_ms).cast("bigint"), "subject": subject,
             "bad": F.coalesce(bad, F.lit(False)), "value": none if value is None else value,
             "level": none if level is None else level, "hold": F.lit(0) if hold is None else hold,
             "cluster": none if cluster is None else cluster, "message": none if message is None else message,
             "muted_by": F.expr(NO_IDS) if muted_by is None else muted_by,
             "muted_level": none if muted_level is None else muted_level,
             **{c: lines.get(c, none) for c in ("warning", "critical", "h")}}
    kinds = {"value": "double", "warning": "double", "critical": "double", "h": "double", "hold": "int",
             "level": "string", "cluster": "string", "message": "string", "muted_level": "string"}
    return rows.select(*[(given[c].cast(kinds[c]) if c in kinds else given[c]).alias(c) for c in FINDING])


# ---- lines and levels
def lb_lines(warning: float, critical: float | None, percent: bool) -> dict[str, float]:
    """Two lines of a balancer rule: critical is given or twice the warning (a share stops at 100).

    A share clears 2 points, at most a fifth of the line, below it; a count a tenth below.
    """
    double = min(100.0, warning * 2) if percent else warning * 2
    h = min(P.HYSTERESIS, warning * 0.2) if percent else max(1, round(warning * 0.1))
    return {"warning": warning, "critical": max(critical or double, warning), "h": h}


def level_now(value: Column, warning: Column, critical: Column) -> Column:
    """Level of a value against two lines without history."""
    return F.when(value >= critical, "critical").when(value >= warning, "warning")


def with_level(found: DataFrame, base: str = "warning") -> DataFrame:
    """The level a finding shows now: from its value if it has lines, else its own or the rule's."""
    by_value = level_now(F.col("value"), F.col("warning"), F.col("critical"))
    own = F.coalesce("level", F.lit(base))
    return found.withColumn("level_now", F.when(F.col("bad"), F.when(F.col("warning").isNotNull(), by_value)
                                                .otherwise(own)))


def _lit_lines(lines: Mapping[str, float], when: Column | None = None) -> dict[str, Column]:
    return {k: F.lit(float(v)) if when is None else F.when(when, F.lit(float(v))) for k, v in lines.items()}


# ---- application logs
def logs_stale(clusters: DataFrame, files: DataFrame, rule_id: str, now: int, minutes: int) -> DataFrame:
    """Clusters whose newest log file is too old. ``files`` are (cluster, hour_ms, name).

    Looks back over the hours the rule covers and two more. The newest hour with files decides: the
    latest epoch in its file names, or the end of the hour if no name has one.
    """
    here, back = now // HOUR * HOUR, math.ceil(minutes / 60) + 2
    stamp = F.nullif(F.regexp_extract("name", r"^(\d{9,11})[-_.]", 1), F.lit("")).cast("bigint") * 1000
    hours = (files.filter(F.col("hour_ms").between(here - (back - 1) * HOUR, here))
             .groupBy("cluster", "hour_ms").agg(F.max(stamp).alias("stamp")))
    newest = hours.groupBy("cluster").agg(
        F.max_by(F.coalesce("stamp", F.col("hour_ms") + HOUR - 1), "hour_ms").alias("newest"))
    rows = clusters.select("cluster").distinct().join(newest, "cluster", "left")
    age = (F.lit(now) - F.col("newest")) / MINUTE
    return findings(rows, rule_id, now, F.col("cluster"), F.col("newest").isNull() | (age >= minutes),
                    F.bround(age), cluster=F.col("cluster"))


def log_errors(logs: DataFrame, rule_id: str, now: int, minutes: int, threshold: int, query: str = "level:error",
               mutes: Sequence[Mute] = ()) -> DataFrame:
    """Clusters with at least ``threshold`` matching lines; lines with a muted signature do not count."""
    entries = active(mutes, "signature", "log_errors")
    texts = [c for c in P.TEXT_COLUMNS if c in logs.columns]
    known = _any([m.cluster(F.col("cluster")) & _any([true_or_false(contains_text(F.col(c).cast("string"), s))
                                                      for c in texts for s in m.signatures]) for m in entries])
    matches = LogQuery(now - minutes * MINUTE, now, query).apply(logs)
    rows = matches.groupBy("cluster").agg(F.count("*").alias("all_lines"), F.count(F.when(~known, 1)).alias("n"))
    found = findings(rows, rule_id, now, F.col("cluster"), F.col("n") >= threshold, F.col("n"), cluster=F.col("cluster"))
    # all lines of a muted subject: kept, as muted by the entries of its cluster
    over = rows.filter((F.col("all_lines") >= threshold) & (F.col("n") < threshold)).select("cluster")
    silenced = found.join(over, "cluster", "left_semi")
    ids = hit_ids([(m.id, m.cluster(F.col("cluster"))) for m in entries])
    return found.join(over, "cluster", "left_anti").select(*FINDING).unionByName(mute(silenced, ids).select(*FINDING))


# ---- balancers
def lb_logs_stale(latest: DataFrame, rule_id: str, now: int, minutes: int, each: bool = False) -> DataFrame:
    """Balancers (lb, end_ms of the newest file, NULL for none) without new files: each one, or all of them."""
    age = (F.lit(now) - F.col("end_ms")) / MINUTE
    if each:
        return findings(latest, rule_id, now, F.col("lb"), age.isNull() | (age >= minutes), F.bround(age))
    newest = latest.agg(F.max("end_ms").alias("end_ms"))
    return findings(newest, rule_id, now, F.lit("All load balancers"), age.isNull() | (age >= minutes), F.bround(age))


def split_codes(codes: Sequence[str]) -> tuple[list[str], list[int]]:
    """Classes, and the single codes no listed class covers already."""
    classes = [c for c in dict.fromkeys(codes) if c.endswith("xx")]
    return classes, [int(c) for c in dict.fromkeys(codes) if not c.endswith("xx") and f"{c[0]}xx" not in classes]


def tg_rates(minutes: DataFrame, start: int, end: int, codes: Sequence[str],
             target_groups: Sequence[str] = (), hit_now: str | None = None) -> DataFrame:
    """Per target group: matching and all requests of the window and of the 24 hours before. One scan.

    ``hit_now`` is an SQL test that replaces the codes in the window itself.
    """
    classes, singles = split_codes(codes)
    tests = [web.class_test(c) for c in classes] + ([f"elb_code IN ({', '.join(map(str, singles))})"] if singles else [])
    hit = "(" + " OR ".join(tests) + ")"
    now = f"minute_ms BETWEEN {start // MINUTE * MINUTE} AND {end}"
    day = f"minute_ms BETWEEN {(start - 24 * HOUR) // MINUTE * MINUTE} AND {start}"
    rows = minutes.filter(F.col("tg").isNotNull() & F.expr(f"({now}) OR ({day})"))
    if target_groups:
        rows = rows.filter(F.col("tg").isin(list(target_groups)))
    sums = rows.groupBy("tg").agg(
        F.min("cluster").alias("cluster"), sum_when(f"{now} AND {hit_now or hit}", "n").alias("n"), sum_when(now, "n").alias("total"),
        sum_when(f"{day} AND {hit}", "n").alias("usual_n"), sum_when(day, "n").alias("usual_total"))
    return (sums.filter("total > 0").withColumn("usual", F.expr("100D * usual_n / nullif(usual_total, 0)")))


def _unusual(share: str, times: float) -> str:
    return "true" if not times else f"(usual IS NULL OR (usual = 0 AND {share} > 0) OR {share} >= usual * {times})"


def _finish(rates: DataFrame, candidate: str, watch: str, bad: str, mutes: Sequence[Mute], rule_type: str,
            rule_codes: Sequence[str], start: int, end: int, path_counts: DataFrame | None,
            error_logs: DataFrame | None, firing: DataFrame | None) -> DataFrame:
    """Judge every target group, take muted paths out of both counts and judge again, then signatures.

    ``candidate``, ``watch`` and ``bad`` are SQL tests over {n} and {total}. Signatures are looked at for bad
    groups, and for watched ones whose alert is ``firing`` (subject column).
    """
    rows = rates.withColumns({"candidate": F.expr(candidate.format(n="n", total="total")), "watch0": F.expr(watch.format(n="n", total="total")),
                              "bad0": F.expr(bad.format(n="n", total="total"))})
    if path_counts is not None and active(mutes, "path", rule_type, rule_codes):
        rows = rows.join(muted_paths(path_counts, mutes, rule_type, rule_codes), "tg", "left")
    else:
        rows = rows.withColumns({"muted_n": F.lit(0), "muted_total": F.lit(0), "path_ids": F.expr(NO_IDS)})
    rows = rows.withColumns({c: F.when(F.col("candidate"), F.coalesce(c, F.lit(0))).otherwise(0)
                             for c in ("muted_n", "muted_total")})
    rows = rows.withColumns({"n2": F.greatest(F.lit(0), F.col("n") - F.col("muted_n")),
                             "total2": F.greatest(F.lit(0), F.col("total") - F.col("muted_total"))})
    rows = rows.withColumns({"watch": F.col("candidate") & F.expr(watch.format(n="n2", total="total2")),
                             "bad": F.col("candidate") & F.expr(bad.format(n="n2", total="total2"))})
    looked = F.col("bad")
    if firing is not None:
        marks = firing.select(F.col("subject").alias("tg")).distinct().withColumn("firing", F.lit(True))
        rows = rows.join(marks, "tg", "left")
        looked = looked | (F.col("watch") & F.coalesce("firing", F.lit(False)))
    if path_counts is not None and error_logs is not None and active(mutes, "signature", rule_type, rule_codes):
        rows = rows.join(muted_signatures(path_counts, error_logs, mutes, rule_type, rule_codes, start, end), "tg", "left")
    else:
        rows = rows.withColumn("signature_ids", F.expr(NO_IDS))
    ids = (F.when(F.col("bad0") & ~F.col("bad"), F.coalesce("path_ids", F.expr(NO_IDS)))
           .when(looked, F.coalesce("signature_ids", F.expr(NO_IDS))).otherwise(F.expr(NO_IDS)))
    return rows.withColumn("ids", ids)


def _lb_findings(rows: DataFrame, rule_id: str, now: int, value: Column, before: Column,
                 lines: Mapping[str, float]) -> DataFrame:
    """Findings of judged target groups; muted ones keep the level they had before paths were taken out."""
    muted = F.size("ids") > 0
    was = F.coalesce(level_now(before, F.lit(float(lines["warning"])), F.lit(float(lines["critical"]))), F.lit("warning"))
    return findings(rows, rule_id, now, F.col("tg"), F.col("bad") & ~muted, value,
                    lines=_lit_lines(lines, F.col("watch") & ~muted), cluster=F.col("cluster"), muted_by=F.col("ids"),
                    muted_level=F.when(muted, was))


def lb_errors(minutes: DataFrame, rule_id: str, now: int, window_minutes: int, threshold_percent: float,
              critical_percent: float | None = None, status_class: str = "5xx", min_requests: int = 50,
              vs_usual: float = 0, target_groups: Sequence[str] = (), mutes: Sequence[Mute] = (),
              path_counts: DataFrame | None = None, error_logs: DataFrame | None = None,
              firing: DataFrame | None = None) -> DataFrame:
    """Share of 5xx (or 4xx) answers per target group. The data is some minutes behind ``now``."""
    end = now - P.LB_LAG_MINUTES * MINUTE
    start = end - window_minutes * MINUTE
    lines = lb_lines(threshold_percent, critical_percent, True)
    share = "(100D * {n} / nullif({total}, 0))"
    candidate = f"coalesce({{total}} >= {min_requests} AND {share} > {lines['warning'] - lines['h']}, false)"
    watch = f"({candidate} AND {_unusual(share, vs_usual)})"
    bad = f"coalesce({watch} AND {share} >= {lines['warning']}, false)"
    codes = [status_class]
    # server errors of this rule have no upper bound, the usual rate takes the class
    rates = tg_rates(minutes, start, end, codes, target_groups, "elb_code >= 500" if status_class == "5xx" else None)
    rows = _finish(rates, candidate, watch, bad, mutes, "lb_errors", codes, start, end, path_counts, error_logs, firing)
    value = F.coalesce(pct(F.col("n2"), F.col("total2")), F.lit(0.0))
    return _lb_findings(rows, rule_id, now, value, F.expr(share.format(n="n", total="total")), lines)


def lb_status(minutes: DataFrame, rule_id: str, now: int, window_minutes: int, codes: Sequence[str], threshold: int,
              critical: int | None = None, threshold_percent: float = 0, vs_usual: float = 0,
              target_groups: Sequence[str] = (), mutes: Sequence[Mute] = (), path_counts: DataFrame | None = None,
              error_logs: DataFrame | None = None, firing: DataFrame | None = None) -> DataFrame:
    """Number of answers with given codes or classes per target group."""
    end = now - P.LB_LAG_MINUTES * MINUTE
    start = end - window_minutes * MINUTE
    lines = lb_lines(threshold, critical, False)
    share = "coalesce(100D * {n} / nullif({total}, 0), 0D)"
    candidate = f"({{n}} > {lines['warning'] - lines['h']} AND {share} >= {threshold_percent})"
    watch = f"({candidate} AND {_unusual(share, vs_usual)})"
    bad = f"({watch} AND {{n}} >= {lines['warning']})"
    rates = tg_rates(minutes, start, end, codes, target_groups)
    rows = _finish(rates, candidate, watch, bad, mutes, "lb_status", codes, start, end, path_counts, error_logs, firing)
    return _lb_findings(rows, rule_id, now, F.col("n2"), F.col("n"), lines)


def lb_latency(minutes: DataFrame, rule_id: str, now: int, window_minutes: int, p95_ms: float, min_requests: int = 50
               ) -> DataFrame:
    """95th percentile of the answer time per target group, from the latency bins."""
    end = now - P.LB_LAG_MINUTES * MINUTE
    query = lb.RequestQuery(end - window_minutes * MINUTE, end)
    rows = lb.target_groups(minutes.filter(query.condition(lb.MINUTES))).filter("tg IS NOT NULL AND p95 IS NOT NULL")
    ms = F.col("p95") * 1000
    return findings(rows, rule_id, now, F.col("tg"), (F.col("requests") >= min_requests) & (ms >= p95_ms),
                    F.bround(ms), cluster=F.col("cluster"))


# ---- services
def ecs_targets(snap: health.Snapshot, rule_id: str, now: int, min_unhealthy: int = 1, mutes: Sequence[Mute] = ()
                ) -> DataFrame:
    """Unhealthy targets per cluster; critical when a target group has no healthy one. Muted reasons do not count."""
    entries = active(mutes, "health", "ecs_targets")
    linked = health.links(snap).select("cluster", "tg")
    bad = F.expr(health.BAD_STATE)
    reason = F.coalesce("reason", "state")
    known = hit_ids([(m.id, bad & m.cluster(F.col("cluster")) & matches_any_glob(reason, m.health_reasons))
                     for m in entries])
    targets = linked.join(snap["targets"], "tg", "left").withColumns({"is_bad": F.coalesce(bad, F.lit(False)), "ids": known})
    counted = F.col("is_bad") & (F.size("ids") == 0)
    # targets of a group are counted per (state, ids) before they meet in the group
    groups = targets.groupBy("cluster", "tg", "ids").agg(
        F.count("target_id").alias("total"), F.count(F.when(F.col("state") == "healthy", 1)).alias("healthy"),
        F.count(F.when(F.col("is_bad"), 1)).alias("bad0"), F.count(F.when(counted, 1)).alias("bad"))
    groups = groups.groupBy("cluster", "tg").agg(
        *[F.sum(c).alias(c) for c in ("total", "healthy", "bad0", "bad")], F.flatten(F.collect_list("ids")).alias("ids"))
    no_healthy = (F.col("total") > 0) & (F.col("healthy") == 0)
    rows = groups.groupBy("cluster").agg(
        F.sum("bad0").alias("bad0"), F.sum("bad").alias("bad"), F.bool_or(no_healthy).alias("empty0"),
        F.bool_or(no_healthy & ((F.col("bad") > 0) | (F.col("bad0") == 0))).alias("empty"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    was, still = (F.col(e) | (F.col(b) >= min_unhealthy) for e, b in (("empty0", "bad0"), ("empty", "bad")))
    found = findings(rows, rule_id, now, F.col("cluster"), still, F.col("bad"),
                     F.when(F.col("empty"), "critical").otherwise("warning"), cluster=F.col("cluster"))
    muted = rows.filter(was & ~still & (F.size("ids") > 0)).select(
        "cluster", F.col("ids").alias("mids"), F.when(F.col("empty0"), "critical").otherwise("warning").alias("mlevel"))
    return (found.join(muted, "cluster", "left")
            .withColumns({"muted_by": F.coalesce("mids", "muted_by"), "muted_level": F.coalesce("mlevel", "muted_level")})
            .select(*FINDING))


def ecs_tasks(services: DataFrame, rule_id: str, now: int) -> DataFrame:
    """Services running fewer tasks than desired; none at all is critical. Deployments get some minutes."""
    live = services.filter("coalesce(status, 'ACTIVE') = 'ACTIVE' AND desired > 0")
    short, down = F.col("running") < F.col("desired"), F.col("running") == 0
    hold = F.when(short & ~down & (F.col("rollout") == "IN_PROGRESS"), P.DEPLOY_GRACE_MINUTES).otherwise(0)
    return findings(live, rule_id, now, F.concat_ws(" / ", "cluster", "service"), short, F.col("running"),
                    F.when(down, "critical").otherwise("warning"), hold=hold, cluster=F.col("cluster"))


SHORT_OF_TASKS = "coalesce(status, 'ACTIVE') = 'ACTIVE' AND desired > 0 AND running < desired"


def instance_lost() -> Column:
    """A lost agent, or a status that is neither active nor draining."""
    status = F.upper(F.coalesce("status", F.lit("ACTIVE")))
    return ((F.col("agent_connected") == F.lit(False)) & (status == "ACTIVE")) | ~status.isin("ACTIVE", "DRAINING")


def ecs_instances(history: DataFrame, services: DataFrame, rule_id: str) -> DataFrame:
    """Instances with a lost agent or a wrong status, and instances gone while services are short of tasks.

    ``history`` are instance snapshots (at_ms, cluster, instance_id, status, agent_connected) of several
    checks; ``services`` the services of the same checks (at_ms, cluster, status, desired, running).
    A missing instance alerts at most 24 hours; once it does not alert it is forgotten.
    """
    lost, subject = instance_lost(), F.concat_ws(" / ", "cluster", "instance_id")
    checks = services.groupBy("at_ms", "cluster").agg(F.expr(f"bool_or({SHORT_OF_TASKS}) AS short"))
    present = history.groupBy("at_ms", "cluster").agg(F.count("*").alias("instances"))
    checks = (checks.join(present, ["at_ms", "cluster"], "left")
              .select("at_ms", "cluster", (F.col("short") | F.col("instances").isNull()).alias("alarming")))
    per_cluster = W.partitionBy("cluster").orderBy("at_ms")
    # a run of alarming checks ends at the next calm one: from there on a missing instance is forgotten
    calm = F.when(~F.col("alarming"), F.col("at_ms"))
    following = per_cluster.rowsBetween(W.currentRow, W.unboundedFollowing)
    day = 24 * HOUR
    a_day_on = per_cluster.rangeBetween(day, W.unboundedFollowing)
    checks = checks.withColumns({"next_calm": F.min(calm).over(following), "next_at": F.lead("at_ms").over(per_cluster),
                                 "day_on": F.min("at_ms").over(a_day_on)})
    own = W.partitionBy("cluster", "instance_id").orderBy("at_ms")
    seen = history.select("at_ms", "cluster", "instance_id").withColumn("again_at", F.lead("at_ms").over(own))
    leaves = (seen.join(checks.select("at_ms", "cluster", F.col("next_at").alias("gone_at")), ["at_ms", "cluster"])
              .filter("gone_at IS NOT NULL AND (again_at IS NULL OR again_at > gone_at)")
              .select("cluster", "instance_id", "gone_at", "again_at"))
    calm_at = checks.select("cluster", F.col("at_ms").alias("gone_at"), "next_calm", "day_on")
    leaves = leaves.join(calm_at, ["cluster", "gone_at"])
    a_day = F.col("gone_at") + day
    last = F.least(F.coalesce("day_on", a_day), F.coalesce("next_calm", F.lit(2 ** 62)), F.coalesce("again_at", F.lit(2 ** 62)))
    # the run ends at the first calm check, the first one after 24 hours, or when the instance is back (which reports itself)
    # range join by day: an absence touches two days, and that of its last check
    touched = F.concat(F.sequence(F.floor(F.col("gone_at") / day), F.floor(F.least("until", a_day) / day)), F.array(F.floor(F.col("until") / day)))
    leaves = leaves.withColumn("until", last).withColumn("day", F.explode(F.array_distinct(touched)))
    missing = (leaves.join(checks.select("cluster", "at_ms", "alarming", F.floor(F.col("at_ms") / day).alias("day")),
                           ["cluster", "day"])
               .filter("at_ms >= gone_at AND at_ms <= until AND (again_at IS NULL OR at_ms < again_at)"))
    missing = missing.withColumn("bad", F.col("alarming") & (F.col("at_ms") - F.col("gone_at") < 24 * HOUR))
    parts = [history.select("at_ms", "cluster", "instance_id", lost.alias("bad")),
             missing.select("at_ms", "cluster", "instance_id", "bad")]
    rows = parts[0].unionByName(parts[1])
    return findings(rows, rule_id, F.col("at_ms"), subject, F.col("bad"), level=F.lit("critical"),
                    cluster=F.col("cluster"))


def ecs_usage(points: DataFrame, rule_id: str, now: int, minutes: int, metric: str = "cpu",
              overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Average use per cluster over the last minutes against two lines, some clusters with their own."""
    rows = health.recent_average(points.filter(F.col("metric") == metric), now, minutes)

    def line(name: str) -> Column:
        own = {c: v[name] for c, v in (overrides or {}).items()}
        chosen = F.lit(float(P.USAGE_LINES[metric][name]))
        for cluster, value in own.items():
            chosen = F.when(F.col("cluster") == cluster, F.lit(float(value))).otherwise(chosen)
        return chosen
    lines = {"warning": line("warning"), "critical": line("critical"), "h": F.lit(float(P.HYSTERESIS))}
    return findings(rows, rule_id, now, F.col("cluster"), F.col("avg") >= lines["warning"], F.round("avg", 1),
                    lines=lines, cluster=F.col("cluster"))


# ---- the service's own errors, and the converter
def top_errors(requests: DataFrame, now: int, minutes: int, limit: int = 3) -> DataFrame:
    """(what, n, total): the most frequent server errors by status, method and short path; 507 is left out."""
    errors = _server_errors(requests, now, minutes)
    what = F.concat_ws(" ", F.col("elb_code").cast("string"), "method", web.short_path(F.col("path")))
    total = errors.agg(F.count("*")).scalar()
    return (errors.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "what").limit(limit).withColumn("total", total))


def _server_errors(requests: DataFrame, now: int, minutes: int) -> DataFrame:
    return requests.filter((F.col("ts_ms") >= now - minutes * MINUTE) & (F.col("ts_ms") <= now)
                           & (F.col("elb_code") >= 500) & (F.col("elb_code") != 507))


def app_errors(requests: DataFrame, rule_id: str, now: int, minutes: int, threshold: int) -> DataFrame:
    total = _server_errors(requests, now, minutes).agg(F.count("*").alias("n"))
    return findings(total, rule_id, now, F.lit("Service API"), F.col("n") >= threshold, F.col("n"))


def converter(ledger: DataFrame, failures: DataFrame, rule_id: str, now: int, stalled_minutes: int,
              mutes: Sequence[Mute] = ()) -> DataFrame:
    """The converter is stale (newest ledger commit too old), or an hour failed: (message) rows of ``failures``."""
    entries = active(mutes, "converter", "app_converter")
    subject = F.lit("Load balancer log converter")
    newest = ledger.agg(F.max("at_ms").alias("at_ms"))
    age = (F.lit(now) - F.col("at_ms")) / MINUTE
    stale = F.coalesce(age >= stalled_minutes, F.lit(True))
    failed = failures.agg(F.max_by("message", "at_ms").alias("message"))
    rows = newest.withColumn("failed", failed.scalar()).withColumn("stale", stale).withColumn("age", age)
    found = findings(rows, rule_id, now, subject, F.col("stale") | F.col("failed").isNotNull(),
                     F.when(F.col("stale"), F.bround("age")),
                     message=F.when(F.col("stale"), "has not committed lately").otherwise(F.col("failed")))
    known = [(m.id, F.col("bad") & F.col("value").isNull() & true_or_false(_any(
        [contains_text("message", x) for x in m.converter_errors]))) for m in entries]
    return mute(found, hit_ids(known)).select(*FINDING)


# ---- explaining a finding
def explain(tables: lb.RequestTables, logs: DataFrame, tg: str, codes: Sequence[str], start: int, end: int,
            snap: health.Snapshot | None = None, signatures: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The evidence next to a balancer finding: codes and who answered, failing paths with their share, the usual
    rate, target health, and the service's own error kinds in the same minutes."""
    classes, singles = split_codes(codes)
    scope = {"target_groups": [tg]}
    query = lb.RequestQuery(start, end, status_classes=classes, status_codes=[] if classes else singles, **scope)
    everything = lb.RequestQuery(start, end, **scope)
    keys = ["method", "path_group"]
    failing = lb.path_table(query.paths(tables), "requests", 3).select(*keys, "requests", "top_code")
    whole = lb.path_stats(everything.paths(tables)).select(*keys, F.col("requests").alias("all_requests"))
    cluster = web.cluster_of(F.lit(tg))
    window = logs.filter(F.col("log_time_ms").between(start - 2 * MINUTE, end + 2 * MINUTE)
                         & (F.col("cluster") == cluster) & (F.lower("level") == "error"))
    out = {"codes": lb.code_counts(query.minutes(tables)),
           "paths": failing.join(whole, keys, "left").orderBy(F.desc("requests")),
           "usual": tg_rates(tables.minutes, start, end, codes, [tg]).select("tg", "usual", "usual_n", "usual_total"),
           "errors": errors.without_muted(errors.error_groups(window, None), list(signatures))}
    if snap is not None:
        out["health"] = health.target_group_health(snap["targets"].filter(F.col("tg") == tg))
    return out

