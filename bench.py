"""Headline queries, one JSON line.

Part 1 runs registered queries on $BENCH_SF_DIR. Part 2 repeats the published figures at their own size:
about 19 million request rows (``events`` multiplied), written once as hour partitions with roll-ups, then
summary, paths, page and word search over all of them, and the conversion of one busy hour of raw lines.
Set BENCH_ROWS=0 to leave part 2 out.
"""
from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from opslens.operators import access, lb  # noqa: E402
from opslens.operators.lb import LongSteps, RequestQuery, RequestTables  # noqa: E402
from opslens.functions.times import DAY, HOUR  # noqa: E402
from opslens.plans import all_queries, views  # noqa: E402
from opslens.session import build_session  # noqa: E402
from opslens.sources import writers  # noqa: E402

HEADLINE = [
    "log_search_text", "log_search_negation", "log_filter_contains", "log_histogram", "log_facets", "log_page", "error_kinds",
    "error_kinds_documents", "access_parse", "rollup_minute", "rollup_paths", "latency_percentiles", "lb_totals", "lb_buckets",
    "lb_target_groups", "lb_paths_errors", "lb_paths_slow", "lb_requests_page", "lb_slowest", "lb_filter_words", "stage_wow",
    "stage_health", "day_series", "range_report", "orders_first_seen", "orders_wow", "inbound_delta", "inbound_range", "ab_counts",
    "ab_store_table", "ab_series", "health_status", "alert_rate", "alert_rate_muted", "alert_transitions", "upsert_newest",
]
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "19000000"))
WEEK_START = 1704067200000


def timed(run) -> float:
    start = time.time()
    run()
    return round(time.time() - start, 3)


def finish(df) -> None:
    """Runs the whole plan and takes its rows, as a caller of the query would."""
    df.toArrow()


def at_scale(spark, folder: str, wanted: int) -> dict[str, float]:
    """The published figures: 7 days and about 19 million requests (or BENCH_ROWS)."""
    events = views.table(spark, SF_DIR, "events")
    copies = max(1, round(wanted / events.count()))
    week = 7 * 24 * 3600_000
    base = views.request_rows(events.repartition(int(CPUS) * 4))
    base.write.parquet(f"{folder}/base")
    # each copy lands at its own offset, folded into seven days, under its own trace id
    many = spark.read.parquet(f"{folder}/base").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = writers.with_hour(many.withColumns({
        "ts_ms": WEEK_START + F.pmod(F.col("ts_ms") + F.col("copy") * 7_919_003, F.lit(week)),
        "trace_id": F.concat_ws("-", "trace_id", "copy"), "raw": F.concat_ws("-", "raw", "copy")}).drop("copy"))
    out = {}
    out["scale_write_requests"] = timed(lambda: writers.write_partitions(rows, f"{folder}/requests", ["dt", "hour"]))
    requests = spark.read.parquet(f"{folder}/requests")
    for name, rollup in (("minutes", access.minute_rollup), ("paths", access.path_rollup)):
        out[f"scale_write_{name}"] = timed(lambda: writers.write_partitions(
            writers.with_hour(rollup(requests), "minute_ms"), f"{folder}/{name}", ["dt", "hour"]))
    keys = ["dt", "hour"]

    def rolled(name: str, source: str, step: int):
        # longer steps as the store keeps them: a partition a day
        rows = access.coarser(spark.read.parquet(f"{folder}/{source}").drop(*keys), step)
        out[f"scale_write_{name}"] = timed(lambda: writers.write_partitions(writers.with_hour(rows, "minute_ms").drop("hour"), f"{folder}/{name}", ["dt"]))
        return spark.read.parquet(f"{folder}/{name}").drop(*keys)
    steps = []
    for name in ("minutes", "paths"):
        hours = rolled(f"{name}_by_hour", name, HOUR)
        steps.append(LongSteps(hours, rolled(f"{name}_by_day", f"{name}_by_hour", DAY)))
    tables = RequestTables(*[spark.read.parquet(f"{folder}/{n}").drop(*keys) for n in ("requests", "minutes", "paths")], None, *steps)
    query = RequestQuery(WEEK_START, WEEK_START + week - 1)
    word = RequestQuery(WEEK_START, WEEK_START + week - 1, words='s3.myshopify -"POST https" Root=1-4*7')

    def summary():
        page = lb.summary(query, tables, 3 * 3600_000)
        for part in ("totals", "buckets", "target_groups"):
            finish(page[part])
        page["cells"].unpersist()

    runs = {
        "b1_summary": summary,
        "b2_paths": lambda: finish(lb.path_table(query.paths(tables, None), "errors", 50)),
        "b3_page": lambda: finish(lb.request_page(query, tables, 100, 250)),
        "b4_word_search": lambda: finish(lb.status_totals(word.minutes(tables))),
    }
    for name, run in runs.items():
        for label in (f"{name}_cold", name):
            spark.catalog.clearCache()
            out[label] = timed(run)
    # one busy hour of one balancer: raw gz text -> request rows -> both roll-ups
    lines = views.access_lines(spark, SF_DIR).select("raw")
    lines.repartition(12).write.option("compression", "gzip").text(f"{folder}/raw")

    def convert():
        parsed = access.parse_requests(spark.read.text(f"{folder}/raw").withColumnRenamed("value", "raw"))
        parsed.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/hour")
        hour = spark.read.parquet(f"{folder}/hour")
        access.path_rollup(hour).write.mode("overwrite").parquet(f"{folder}/hour_paths")
        access.minute_rollup(hour).write.mode("overwrite").parquet(f"{folder}/hour_minutes")
    out["b5_convert_hour_cold"] = timed(convert)
    out["b5_convert_hour"] = timed(convert)
    out["scale_rows"] = requests.count()
    return out


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    finish(known["log_count"].run(spark, SF_DIR))                     # JVM and Parquet reader warm
    times = {}
    for name in HEADLINE:
        finish(known[name].run(spark, SF_DIR))
        spark.catalog.clearCache()                                    # nothing kept from the warm-up run
        times[name] = timed(lambda: finish(known[name].run(spark, SF_DIR)))
    scale = {}
    if ROWS:
        folder = tempfile.mkdtemp(prefix="opslens-bench-")
        try:
            scale = at_scale(spark, folder, ROWS)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    rows = int(scale.pop("scale_rows", 0))
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": {**times, **scale}, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS),
                      "scale_rows": rows}))


if __name__ == "__main__":
    main()
