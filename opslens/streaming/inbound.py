"""Inbound windows from a stream of index snapshots, which keeps the time of the runs itself.

Under one root, a folder a batch:

``runs``     the snapshots of each source's newest two runs: what the next batch needs, and no more
``windows``  window rows by run (``at``); a run counted again, as more of it came, replaces its rows

A run without any new documents has its ``_all`` row with 0, as in ``operators.inbound.inbound_delta``; one without any index is told by a row whose
index is NULL. Parts of the newest two runs, or a run between them, may come late, a row may come twice; a run older than those is left out.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P
from ..operators.inbound import inbound_delta
from ..sources import writers as S

KEPT_RUNS = 2


def _newest_runs(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, snapshot_ms of the newest two runs: only run times are ordered."""
    order = W.partitionBy(*keys).orderBy(F.desc("snapshot_ms"))
    return snapshots.select(*keys, "snapshot_ms").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= KEPT_RUNS)


def add_runs(snapshots: DataFrame, root: str, batch: int, keys: Sequence[str] = ()) -> None:
    """One batch of snapshots. It builds on the batches before it, so that repeated, it replaces what it wrote.

    ``keys`` are columns of independent sources, never NULL.
    """
    spark, table = snapshots.sparkSession, f"{root}/runs"
    kept = sorted(int(n.removeprefix("batch=")) for n in S.note_names(spark, table) if n.startswith("batch="))
    before = [b for b in kept if b < batch][-1:]
    rows = snapshots
    if before:
        known = spark.read.parquet(table).filter(F.col("batch") == before[0]).drop("batch")
        since = known.groupBy(*keys).agg(F.min("snapshot_ms").alias("since"), F.count_distinct("snapshot_ms").alias("runs"))
        if keys:
            new = rows.join(since, list(keys), "left")
        else:
            one = since.first()
            new = rows.withColumns({"since": F.lit(one.since).cast("bigint"), "runs": F.lit(one.runs).cast("bigint")})
        rows = known.unionByName(new.filter(f"runs IS NULL OR runs < {KEPT_RUNS} OR snapshot_ms >= since").drop("since", "runs"))
    rows = rows.distinct().persist()
    try:
        fresh = inbound_delta(rows, keys)
        S.write_batch(fresh.withColumn("month", F.trunc(F.timestamp_millis("t"), "month")), f"{root}/windows", batch, ["month"])
        S.write_batch(rows.join(_newest_runs(rows, keys).drop("rank"), [*keys, "snapshot_ms"], "left_semi"), table, batch)
    finally:
        rows.unpersist()
    for old in kept:
        if old < batch and old not in before:
            S.remove(spark, f"{table}/batch={old}")


def read_runs(spark: SparkSession, root: str, keys: Sequence[str] = ()) -> DataFrame | None:
    """Window rows as ``inbound_delta`` gives them for all runs; None before anything came."""
    rows = S.read_or_none(spark, f"{root}/windows")
    if rows is None:
        return None
    last = rows.filter(F.col("tenant") == P.ALL).groupBy(*keys, "at").agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "at", "batch"], "left_semi").select(*keys, "t", "tenant", "orders", "docs", "span_min", "src", "at")


def stream_inbound(snapshots: DataFrame, root: str, checkpoint: str, keys: Sequence[str] = (), trigger: dict | None = None) -> StreamingQuery:
    return (snapshots.writeStream.foreachBatch(lambda rows, batch: add_runs(rows, root, batch, keys)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 minutes"})).start())
