"""Service inventory: links between clusters and target groups, status, utilisation.

Snapshots are DataFrames: clusters(cluster), services(cluster, service, status, desired, running, rollout, tg),
instances(cluster, instance_id, status, agent_connected), targets(tg, target_id, state, reason), groups(tg, error).
"""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions.times import MINUTE, floor_to

Snapshot = Mapping[str, DataFrame]
_BAD = ", ".join(f"'{s}'" for s in P.BAD_TARGET_STATES)
BAD_STATE = f"state IN ({_BAD})"


def target_group_health(targets: DataFrame) -> DataFrame:
    """Healthy, bad and other targets per target group."""
    return targets.groupBy("tg").agg(
        F.count("*").alias("total"), F.expr("count_if(state = 'healthy') AS healthy"),
        F.expr(f"count_if({BAD_STATE}) AS bad"),
        F.expr(f"count_if(state IS NULL OR state NOT IN ('healthy', {_BAD})) AS other"))


def links(snap: Snapshot) -> DataFrame:
    """(cluster, tg, linked_by): a service registers in it, it holds an instance of the cluster, or by name.

    Three equi joins; the name link joins the group's name with and without its prefix.
    """
    groups = snap["groups"].select("tg")
    by_service = snap["services"].filter("tg IS NOT NULL").select("cluster", "tg").join(groups, "tg", "left_semi")
    by_instance = (snap["targets"].select("tg", F.col("target_id").alias("instance_id"))
                   .join(snap["instances"].select("cluster", "instance_id"), "instance_id").select("cluster", "tg"))
    named = groups.withColumn("cluster", F.explode(F.expr(
        "CASE WHEN tg LIKE 'tg-%' THEN array(tg, substr(tg, 4)) ELSE array(tg) END")))
    by_name = named.join(snap["clusters"].select("cluster"), "cluster", "left_semi").select("cluster", "tg")
    parts = [df.distinct().withColumn("how", F.lit(how)) for how, df in
             [("service", by_service), ("instances", by_instance), ("name", by_name)]]
    return (reduce(DataFrame.unionByName, parts).groupBy("cluster", "tg")
            .agg(F.sort_array(F.collect_set("how")).alias("linked_by")))


def unlinked_groups(snap: Snapshot, linked: DataFrame) -> DataFrame:
    """Target groups no cluster uses."""
    return snap["groups"].join(linked.select("tg"), "tg", "left_anti")


def instances_behind(snap: Snapshot, linked: DataFrame) -> DataFrame:
    """Instances with whether one of their cluster's target groups holds them."""
    behind = (snap["targets"].select("tg", F.col("target_id").alias("instance_id")).join(linked, "tg")
              .select("cluster", "instance_id").distinct().withColumn("behind_balancer", F.lit(True)))
    return (snap["instances"].join(behind, ["cluster", "instance_id"], "left")
            .withColumn("behind_balancer", F.coalesce("behind_balancer", F.lit(False))))


def cluster_health(snap: Snapshot, linked: DataFrame | None = None) -> DataFrame:
    """Per cluster: down, degraded, healthy or none, with the counts behind it; problems first."""
    linked = links(snap) if linked is None else linked
    groups = target_group_health(snap["targets"]).join(snap["groups"].select("tg", "error"), "tg", "full_outer")
    of_groups = linked.join(groups, "tg", "left").groupBy("cluster").agg(
        F.count("*").alias("groups"), F.expr("coalesce(sum(healthy), 0) AS healthy_targets"),
        F.expr("coalesce(sum(total), 0) AS targets"), F.expr("coalesce(sum(bad), 0) AS bad_targets"),
        F.expr("bool_or(total > 0 AND healthy = 0) AS group_down"),
        F.expr("bool_or(bad > 0 OR error IS NOT NULL) AS group_bad"))
    of_services = snap["services"].groupBy("cluster").agg(
        F.sum("running").alias("services_running"), F.sum("desired").alias("services_desired"),
        F.expr("count_if(running < desired) AS services_short"),
        F.expr("bool_or(desired > 0 AND running = 0) AS service_down"),
        F.expr("bool_or(running < desired OR rollout = 'FAILED') AS service_bad"))
    of_instances = snap["instances"].groupBy("cluster").agg(F.expr("bool_or(NOT agent_connected) AS agent_lost"))
    rows = snap["clusters"].select("cluster")
    for part in (of_groups, of_services, of_instances):
        rows = rows.join(part, "cluster", "left")
    rows = rows.na.fill(0, ["groups", "healthy_targets", "targets", "bad_targets", "services_running",
                            "services_desired", "services_short"]).na.fill(False)
    status = F.expr("CASE WHEN group_down OR service_down THEN 'down' WHEN group_bad OR service_bad OR agent_lost "
                    "THEN 'degraded' WHEN groups > 0 THEN 'healthy' ELSE 'none' END")
    rank = F.expr("CASE status " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in P.STATUS_RANK.items()) + " END")
    return (rows.withColumn("status", status)
            .drop("group_down", "group_bad", "service_down", "service_bad", "agent_lost").orderBy(rank, "cluster"))


def health_summary(clusters: DataFrame) -> DataFrame:
    """Counts over ``cluster_health`` rows."""
    return clusters.agg(
        F.count("*").alias("clusters"), F.expr("count_if(groups > 0) AS with_balancer"),
        F.expr("count_if(groups = 0) AS without_balancer"),
        *[F.expr(f"count_if(status = '{s}') AS {s}") for s in ("down", "degraded", "healthy")],
        F.expr("coalesce(sum(bad_targets), 0) AS unhealthy_targets"),
        F.expr("coalesce(sum(services_short), 0) AS services_below_desired"))


# ---- utilisation
def period_ms(hours: int) -> int:
    """About 60 points per chart, in whole minutes."""
    return max(1, hours) * MINUTE


def utilisation_series(points: DataFrame, hours: int) -> DataFrame:
    """Average per cluster, metric and period of about ``hours`` minutes."""
    return (points.groupBy("cluster", "metric", floor_to("t_ms", period_ms(hours)).alias("t_ms"))
            .agg(F.round(F.avg("value"), 2).alias("value")))


def utilisation(points: DataFrame, hours: int) -> DataFrame:
    """Now (the last period), average and maximum of the periods per cluster and metric."""
    return utilisation_series(points, hours).groupBy("cluster", "metric").agg(
        F.max_by("value", "t_ms").alias("now"), F.avg("value").alias("avg"), F.max("value").alias("max"))


def recent_average(points: DataFrame, now: int, minutes: int) -> DataFrame:
    """Mean and peak of the last minutes; if there are none, of the last two points if recent enough."""
    recent = F.col("t_ms") >= now - minutes * MINUTE
    candidates = points.filter(F.col("t_ms") >= now - (minutes + 15) * MINUTE)
    newest = W.partitionBy("cluster", "metric").orderBy(F.desc("t_ms"))
    # two last points per cluster as a fallback: ranked, so the cut happens before the shuffle
    last = (candidates.withColumn("r", F.row_number().over(newest)).filter("r <= 2").groupBy("cluster", "metric")
            .agg(F.avg("value").alias("last_avg"), F.max("value").alias("last_max")))
    inside = candidates.filter(recent).groupBy("cluster", "metric").agg(F.avg("value").alias("avg"),
                                                                        F.max("value").alias("peak"))
    return (last.join(inside, ["cluster", "metric"], "left")
            .select("cluster", "metric", F.coalesce("avg", "last_avg").alias("avg"),
                    F.coalesce("peak", "last_max").alias("peak")))
