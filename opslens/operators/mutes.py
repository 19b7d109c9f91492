"""Mute entries: name, path and signature patterns compiled to predicates.

Entries are configuration (dozens at most), so they become columns of one predicate chain: no join is
needed and every pattern is compiled once.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P
from ..functions import web
from ..functions.text import contains_text, matches_any_glob, true_or_false

LB_TYPES = ("lb_errors", "lb_status", "lb_latency")
NO_IDS = "CAST(array() AS ARRAY<STRING>)"


@dataclass(frozen=True)
class Mute:
    """One entry. Empty scopes match everything; ``rules`` None means every rule type."""
    id: str
    rules: Sequence[str] | None = None
    target_groups: Sequence[str] = ()
    clusters: Sequence[str] = ()
    subjects: Sequence[str] = ()
    paths: Sequence[tuple[str | None, str]] = ()       # (method or None, pattern)
    codes: Sequence[str] = ()
    signatures: Sequence[str] = ()
    health_reasons: Sequence[str] = ()
    converter_errors: Sequence[str] = ()
    enabled: bool = True

    @property
    def kind(self) -> str:
        by_field = [("signature", self.signatures), ("path", self.paths), ("health", self.health_reasons),
                    ("converter", self.converter_errors)]
        return next((name for name, values in by_field if values), "subject")

    @property
    def scoped(self) -> bool:
        return bool(self.target_groups or self.clusters)

    def target_group(self, tg: Column) -> Column:
        if not self.scoped:
            return F.lit(True)
        return matches_any_glob(tg, self.target_groups) | matches_any_glob(web.cluster_of(tg), self.clusters)

    def cluster(self, cluster: Column) -> Column:
        """Scope for rules about clusters: by cluster, or by a target group named after it."""
        if not self.scoped:
            return F.lit(True)
        return (matches_any_glob(cluster, self.clusters) | matches_any_glob(cluster, self.target_groups)
                | matches_any_glob(F.concat(F.lit("tg-"), cluster), self.target_groups))

    def about_codes(self, rule_codes: Sequence[str]) -> bool:
        return not self.codes or not rule_codes or web.codes_overlap(self.codes, rule_codes)

    def path(self, method: Column, path_group: Column) -> Column:
        hits = [true_or_false(matches_any_glob(path_group, [pattern]) &
                              (F.lit(True) if m is None else F.upper(F.coalesce(method, F.lit(""))) == m.upper()))
                for m, pattern in self.paths]
        return _any(hits)

    def code(self, code: Column) -> Column:
        return web.code_matches(code, self.codes) if self.codes else F.lit(True)

    def subject(self, rule_type: str, subject: Column, cluster: Column) -> Column:
        named = matches_any_glob(subject, self.subjects) if self.subjects else F.lit(True)
        if not self.scoped:
            return named
        return named & (self.target_group(subject) if rule_type in LB_TYPES else self.cluster(cluster))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def active(mutes: Sequence[Mute], kind: str, rule_type: str, rule_codes: Sequence[str] = ()) -> list[Mute]:
    return [m for m in mutes if m.enabled and m.kind == kind and (m.rules is None or rule_type in m.rules)
            and m.about_codes(rule_codes)]


def hit_ids(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Sorted ids of the entries whose condition holds."""
    if not pairs:
        return F.expr(NO_IDS)
    found = F.array(*[F.when(condition, F.lit(i)) for i, condition in pairs])
    return F.sort_array(F.array_distinct(F.array_compact(found)))


def first_id(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Id of the first entry whose condition holds, NULL when none does."""
    chosen = F.lit(None).cast("string")
    for i, condition in reversed(pairs):
        chosen = F.when(condition, F.lit(i)).otherwise(chosen)
    return chosen


def mute(findings: DataFrame, ids: Column, level: Column | None = None) -> DataFrame:
    """Stop the findings that have mute ids: they stay in the result, no longer bad, with the level they had."""
    muted = F.size(ids) > 0
    was = F.coalesce(level, F.col("level"), F.lit("warning")) if level is not None else \
        F.coalesce(F.col("level"), F.lit("warning"))
    none = F.lit(None).cast("double")
    return (findings.withColumn("_ids", ids)
            .withColumns({"muted_by": F.when(muted, F.sort_array(F.array_union("muted_by", "_ids")))
                          .otherwise(F.col("muted_by")),
                          "muted_level": F.when(muted, was).otherwise(F.col("muted_level")),
                          "bad": F.col("bad") & ~muted,
                          **{c: F.when(muted, none).otherwise(F.col(c)) for c in ("warning", "critical", "h")}})
            .drop("_ids"))


def mute_subjects(findings: DataFrame, mutes: Sequence[Mute], rule_type: str, rule_codes: Sequence[str] = (),
                  firing: DataFrame | None = None) -> DataFrame:
    """Mute whole subjects by name. Only findings that are bad, or whose alert is firing, are looked at."""
    entries = active(mutes, "subject", rule_type, rule_codes)
    if not entries:
        return findings
    watched = F.col("bad")
    if firing is not None:
        marks = firing.select("rule_id", "subject").distinct().withColumn("_firing", F.lit(True))
        findings = findings.join(marks, ["rule_id", "subject"], "left")
        watched = watched | F.coalesce("_firing", F.lit(False))
    free = (F.size("muted_by") == 0) & watched
    ids = hit_ids([(m.id, free & m.subject(rule_type, F.col("subject"), F.col("cluster"))) for m in entries])
    return mute(findings, ids).drop("_firing")


def muted_paths(path_counts: DataFrame, mutes: Sequence[Mute], rule_type: str, rule_codes: Sequence[str]) -> DataFrame:
    """Per target group what muted paths take out: matching and all requests, and the entries at work.

    ``path_counts`` are (tg, method, path_group, elb_code, n). The first entry that fits a row has it.
    """
    entries = active(mutes, "path", rule_type, rule_codes)
    tg, method, path, code = (F.col(c) for c in ("tg", "method", "path_group", "elb_code"))
    owner = first_id([(m.id, m.target_group(tg) & m.path(method, path) & m.code(code)) for m in entries])
    return (path_counts.withColumn("mute_id", owner).filter("mute_id IS NOT NULL").groupBy("tg").agg(
        F.coalesce(F.sum(F.when(web.code_matches(code, rule_codes), F.col("n"))), F.lit(0)).alias("muted_n"),
        F.sum("n").alias("muted_total"), F.sort_array(F.collect_set("mute_id")).alias("path_ids")))


def muted_signatures(path_counts: DataFrame, error_logs: DataFrame, mutes: Sequence[Mute], rule_type: str,
                     rule_codes: Sequence[str], start: int, end: int) -> DataFrame:
    """(tg, signature_ids) of target groups whose own error lines in the window ± 2 min are all muted ones.

    ``error_logs`` are ERROR lines with cluster, log_time_ms and text columns. At least one line is
    needed, and every failing path has to be one the entries name (unless one names no path).
    """
    entries = active(mutes, "signature", rule_type, rule_codes)
    quiet = active(mutes, "path", rule_type, rule_codes)
    tg, method, path, code = (F.col(c) for c in ("tg", "method", "path_group", "elb_code"))
    scope = F.array_compact(F.array(*[F.when(m.target_group(tg), F.lit(m.id)) for m in entries])) if entries else \
        F.expr(NO_IDS)
    failing = web.code_matches(code, rule_codes) & (F.col("n") > 0)
    taken = _any([m.target_group(tg) & m.path(method, path) & m.code(code) for m in quiet])
    named = _any([m.target_group(tg) & (m.path(method, path) if m.paths else F.lit(True)) for m in entries])
    with_paths = _any([m.target_group(tg) & F.lit(bool(m.paths)) for m in entries])
    groups = (path_counts.withColumn("stray", failing & ~taken & ~named & with_paths).groupBy("tg")
              .agg(F.max("stray").alias("stray")).filter("NOT stray")
              .withColumns({"scope": scope, "cluster": web.cluster_of(tg)}).filter(F.size("scope") > 0))
    texts = [c for c in P.TEXT_COLUMNS if c in error_logs.columns]
    minutes = 2 * 60_000
    lines = error_logs.filter(F.col("log_time_ms").between(start - minutes, end + minutes))
    hits = F.array_compact(F.array(*[F.when(_any([contains_text(F.col(c).cast("string"), s).eqNullSafe(True)
                                                  for c in texts for s in m.signatures]), F.lit(m.id))
                                     for m in entries])) if entries else F.expr(NO_IDS)
    # lines are counted per cluster and set of signatures they show before they meet the target groups
    kinds = lines.groupBy("cluster", hits.alias("shown")).agg(F.count("*").alias("n"))
    joined = groups.join(kinds, "cluster").withColumn("shown", F.array_intersect("shown", "scope"))
    return (joined.groupBy("tg").agg(F.min(F.size("shown")).alias("fewest"),
                                     F.sort_array(F.array_distinct(F.flatten(F.collect_list("shown"))))
                                     .alias("signature_ids"))
            .filter("fewest > 0").drop("fewest"))
