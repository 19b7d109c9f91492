"""Who may see which cluster: grants (user, cluster or '*', level)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def access_levels(pairs: DataFrame, grants: DataFrame) -> DataFrame:
    """'view' or NULL for (user, cluster) pairs: a cluster's own entry wins over '*', anything else denies."""
    own = grants.filter("cluster <> '*'").select("user", "cluster", F.col("level").alias("own"))
    star = grants.filter("cluster = '*'").select("user", F.col("level").alias("star"))
    level = F.coalesce("own", "star")
    return (pairs.join(own, ["user", "cluster"], "left").join(star, "user", "left")
            .withColumn("level", F.when(level == "view", level)).drop("own", "star"))


def cluster_readers(clusters: DataFrame, grants: DataFrame) -> DataFrame:
    """Per cluster the users who may read it, sorted.

    Users with '*' are one list over all clusters; each cluster only takes off those with an own entry,
    so clusters and users are never paired.
    """
    star = (grants.filter("cluster = '*' AND level = 'view'")
            .agg(F.coalesce(F.collect_set("user"), F.expr("CAST(array() AS ARRAY<STRING>)"))).scalar())
    own = grants.filter("cluster <> '*'").groupBy("cluster").agg(
        F.collect_set(F.when(F.col("level") == "view", F.col("user"))).alias("readers"),
        F.collect_set("user").alias("named"))
    rows = clusters.select("cluster").distinct().join(own, "cluster", "left")
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    everyone = F.array_except(F.col("everyone"), F.coalesce("named", none))
    return (rows.withColumn("everyone", star)
            .select("cluster", F.sort_array(F.array_union(everyone, F.coalesce("readers", none))).alias("users")))


def visible(rows: DataFrame, user: str, grants: DataFrame, cluster: Column | None = None) -> DataFrame:
    """Rows whose cluster a user may see; rows without a cluster are hidden."""
    named = cluster if cluster is not None else F.col("cluster")
    mine = grants.filter(F.col("user") == user)
    star = mine.filter("cluster = '*'").agg(F.coalesce(F.max(F.col("level") == "view"), F.lit(False))).scalar()
    own = mine.filter("cluster <> '*'").select(F.col("cluster").alias("_c"), (F.col("level") == "view").alias("_own"))
    return (rows.join(own, named == F.col("_c"), "left").withColumn("_star", star)
            .filter(named.isNotNull() & F.coalesce("_own", "_star")).drop("_c", "_own", "_star"))
