"""Load balancer queries over requests and their roll-ups."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import patterns as P
from ..functions import web
from ..functions.figures import ratio, sum_when
from ..functions.text import like_pattern, true_or_false
from ..functions.times import DAY, HOUR, MINUTE, floor_to
from .access import minute_rollup, path_rollup

MINUTES, PATHS, ROWS = "minute", "paths", "rows"


@dataclass(frozen=True)
class Access:
    """What a user may see by cluster: their own entry wins over '*', anything but 'view' denies."""
    rules: Mapping[str, str]

    def condition(self, cluster: Column) -> Column:
        named = {c: level for c, level in self.rules.items() if c != "*"}
        if self.rules.get("*") == "view":
            denied = [c for c, level in named.items() if level != "view"]
            return cluster.isNotNull() & (~cluster.isin(denied) if denied else F.lit(True))
        allowed = [c for c, level in named.items() if level == "view"]
        return true_or_false(cluster.isin(allowed)) if allowed else F.lit(False)


@dataclass(frozen=True)
class RequestQuery:
    """Filters of the request pages; a None access sees everything."""
    start_ms: int
    end_ms: int
    lbs: Sequence[str] = ()
    target_groups: Sequence[str] = ()      # '-' = requests without one
    domains: Sequence[str] = ()
    status_classes: Sequence[str] = ()
    status_codes: Sequence[int] = ()
    source: str | None = None              # 'app' or 'lb': who answered
    methods: Sequence[str] = ()
    path: str = ""                         # contains; with '*' anchored
    path_group: str = ""
    client: str = ""                       # prefix
    target: str = ""                       # prefix
    min_target_seconds: float | None = None
    words: str = ""
    access: Access | None = None

    def level(self) -> str:
        """The smallest table that holds every filter."""
        if self.path or self.client or self.target or self.words or self.min_target_seconds is not None:
            return ROWS
        if self.methods or self.path_group:
            return ROWS if self.domains else PATHS
        return MINUTES

    def condition(self, level: str) -> Column:
        """The filters a table of this level can apply."""
        parts = list(self._common(level))
        if level != PATHS and self.domains:
            parts.append(F.col("domain").isin(list(self.domains)))
        if level != MINUTES:
            if self.methods:
                parts.append(F.col("method").isin([m.upper() for m in self.methods]))
            if self.path_group:
                parts.append(F.col("path_group") == self.path_group)
        if level == ROWS:
            parts += self._row_only()
        return reduce(lambda a, b: a & b, parts)

    def _common(self, level: str):
        if level == ROWS:
            yield F.col("ts_ms").between(self.start_ms, self.end_ms)
        else:
            yield F.col("minute_ms").between(self.start_ms // MINUTE * MINUTE, self.end_ms)
        if self.access is not None:
            yield self.access.condition(F.col("cluster"))
        if self.lbs:
            yield F.col("lb").isin(list(self.lbs))
        if self.target_groups:
            named = [t for t in self.target_groups if t != "-"]
            choices = [F.col("tg").isin(named)] if named else []
            choices += [F.col("tg").isNull()] if "-" in self.target_groups else []
            yield reduce(lambda a, b: a | b, choices)
        if self.status_classes:
            yield reduce(lambda a, b: a | b, [F.expr(web.class_test(c)) for c in self.status_classes])
        if self.status_codes:
            yield F.col("elb_code").isin([int(c) for c in self.status_codes])
        if self.source:
            answered = F.col("tgt_code").isNotNull()
            yield answered if self.source == "app" else ~answered

    def _row_only(self):
        if self.path:
            pattern = like_pattern(self.path)
            yield F.col("path").ilike(pattern if "*" in self.path else f"%{pattern}%")
        for column, prefix in (("client_ip", self.client), ("target", self.target)):
            if prefix:
                yield (F.col(column).like(like_pattern(prefix) + "%") if "*" in prefix
                       else F.startswith(column, F.lit(prefix)))
        if self.min_target_seconds is not None:
            yield F.col("tgt_t") >= float(self.min_target_seconds)
        for sign, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|(\S+))', self.words):
            text = phrase or word.strip('"')
            if text:
                hit = true_or_false(F.col("raw").ilike(f"%{like_pattern(text)}%"))
                yield ~hit if sign else hit

    # -- the tables that answer it
    def rolled(self, level: str, tables: "RequestTables", step: int | None) -> DataFrame:
        """Rows of a roll-up (MINUTES or PATHS) for the range, in the longest steps that fit between its edges.

        The range starts and ends in minutes, then come hours, and days in the middle; what the longer steps don't cover is
        read in minutes. ``step`` is what the caller tells times apart by (None: not at all), so no longer one is mixed in.
        """
        minutes, long = (tables.minutes, tables.long_minutes) if level == MINUTES else (tables.paths, tables.long_paths)
        if long is None:
            return minutes.filter(self.condition(level))
        parts, covered = [], []
        for grain, start, end in spans(self.start_ms // MINUTE * MINUTE, self.end_ms // MINUTE * MINUTE + MINUTE, step):
            source = {MINUTE: minutes, HOUR: long.hours, DAY: long.days}[grain]
            parts.append(source.filter(replace(self, start_ms=start, end_ms=end - 1).condition(level)))
            covered += [start, end] if grain != MINUTE else []
        if covered and long.rest is not None:
            parts.append(long.rest.filter(replace(self, start_ms=min(covered), end_ms=max(covered) - 1).condition(level)))
        return reduce(DataFrame.unionByName, parts) if parts else minutes.filter(self.condition(level))

    def minutes(self, tables: "RequestTables", step: int | None = MINUTE) -> DataFrame:
        """Minute roll-up rows of the query, from the smallest table with its filters; rows of longer steps where ``step`` allows them."""
        level = self.level()
        parts = []
        if level == MINUTES:
            parts.append(self.rolled(MINUTES, tables, step))
        elif level == PATHS:
            selected = self.rolled(PATHS, tables, step).withColumn("domain", F.lit(None).cast("string"))
            parts.append(selected.drop("method", "path_group"))
        else:
            parts.append(minute_rollup(tables.requests.filter(self.condition(ROWS))))
        if tables.unmerged is not None:
            parts.append(minute_rollup(tables.unmerged.filter(self.condition(ROWS))))
        return reduce(DataFrame.unionByName, parts)

    def paths(self, tables: "RequestTables", step: int | None = MINUTE) -> DataFrame:
        """Path roll-up rows of the query, of longer steps where ``step`` allows them."""
        if self.level() == ROWS or self.domains:
            parts = [path_rollup(tables.requests.filter(self.condition(ROWS)))]
        else:
            parts = [self.rolled(PATHS, tables, step)]
        if tables.unmerged is not None:
            parts.append(path_rollup(tables.unmerged.filter(self.condition(ROWS))))
        return reduce(DataFrame.unionByName, parts)


def spans(start: int, end: int, step: int | None) -> list[tuple[int, int, int]]:
    """[start, end) as (grain, from, to): days in the middle, hours around them, minutes at both edges. Whole minutes in, at most five spans out."""
    def cut(start: int, end: int, grains: list[int]) -> list[tuple[int, int, int]]:
        if start >= end:
            return []
        grain, *finer = grains
        first, last = -(-start // grain) * grain, end // grain * grain
        if first >= last:
            return cut(start, end, finer)
        return [*cut(start, first, finer), (grain, first, last), *cut(last, end, finer)]
    return cut(start, end, [g for g in (DAY, HOUR) if step is None or step % g == 0] + [MINUTE])


@dataclass(frozen=True)
class LongSteps:
    """A roll-up by hour and by day of the days it covers (per balancer), and the minutes of all other days."""
    hours: DataFrame
    days: DataFrame
    rest: DataFrame | None = None


@dataclass(frozen=True)
class RequestTables:
    """Finished requests and roll-ups, the rows of hours not merged yet, and the roll-ups in longer steps if there are any."""
    requests: DataFrame
    minutes: DataFrame
    paths: DataFrame
    unmerged: DataFrame | None = None
    long_minutes: LongSteps | None = None
    long_paths: LongSteps | None = None


# ---- aggregates of roll-up rows
SUMS = ["n", "tgt_t_sum", "tgt_t_n"]
PATH = ["method", "path_group"]


def cells(rollup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll-up rows summed per key, status code, who answered and latency bin.

    The one pass over the roll-up: three plain sums per row, combined on the map side. Everything
    below works on its few rows (codes x bins per key), whatever the time range holds.
    """
    return (rollup.groupBy(*keys, "elb_code", F.col("tgt_code").isNotNull().alias("answered"), "lat_bin")
            .agg(*[F.sum(c).alias(c) for c in SUMS]))


def _class_sums() -> list[Column]:
    return [sum_when(web.class_test(c), "n").alias(name) for c, name in zip([*P.STATUS_CLASSES, "other"], _CLASS_NAMES)]


def _blame_sums() -> list[Column]:
    return [sum_when("elb_code >= 500 AND answered", "n").alias("s5xx_app"),
            sum_when("elb_code >= 500 AND NOT answered", "n").alias("s5xx_lb"),
            sum_when(web.class_test("4xx"), "n").alias("s4xx")]


_CLASS_NAMES = [f"c{c}" for c in P.STATUS_CLASSES] + ["other"]
_BLAME_NAMES = ["s5xx_app", "s5xx_lb", "s4xx"]


def _status(counted: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float], **more: Column) -> DataFrame:
    """Counts, classes, blame, average, percentiles and ``more`` aggregates per key from ``cells`` rows, in one aggregate."""
    bins = F.array(*[F.struct(F.lit(b).alias("lat_bin"), sum_when(f"lat_bin = {b}", "n").alias("n")) for b in range(len(P.LATENCY_EDGES))])
    whole = counted.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(_class_sums() + _blame_sums(), _CLASS_NAMES + _BLAME_NAMES)],
        ratio(F.sum("tgt_t_sum"), F.sum("tgt_t_n")).alias("avg"), bins.alias("bins"), *[c.alias(n) for n, c in more.items()])
    return whole.select(*keys, "requests", *_CLASS_NAMES, *_BLAME_NAMES,
                        (F.col("s5xx_app") + F.col("s5xx_lb")).alias("s5xx"), "avg",
                        *[web.bin_percentile("bins", p).alias(name) for name, p in quantiles.items()], *more)


def status_totals(rollup: DataFrame) -> DataFrame:
    """Requests, status classes, who answered the 5xx, average and percentiles in one row."""
    return _totals(cells(rollup, []))


def _totals(counted: DataFrame) -> DataFrame:
    return _status(counted, [], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("s4xx", "s5xx")


def status_buckets(rollup: DataFrame, step: int) -> DataFrame:
    return (rollup.filter(F.col("minute_ms").isNotNull())
            .groupBy(floor_to("minute_ms", step).alias("t"), "elb_code").agg(F.sum("n").alias("n"))
            .groupBy("t").agg(*_class_sums()))


def bin_percentiles(rollup: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Percentiles (seconds) per group from the latency bins."""
    bins = (rollup.filter(F.col("lat_bin").isNotNull()).groupBy(*keys, "lat_bin").agg(F.sum("n").alias("n"))
            .groupBy(*keys).agg(web.bin_list().alias("bins")))
    return bins.select(*keys, *[web.bin_percentile("bins", p).alias(name) for name, p in quantiles.items()])


def target_groups(rollup: DataFrame) -> DataFrame:
    """Per target group; NULL (no group) is one of them."""
    return _target_groups(cells(rollup, ["tg", "cluster", "lb"]))


def _target_groups(counted: DataFrame) -> DataFrame:
    where = {"cluster": F.min("cluster"), "lbs": F.sort_array(F.collect_set("lb"))}
    return _status(counted, ["tg"], {"p95": 0.95}, **where).drop(*_CLASS_NAMES)


def top_error_paths(paths: DataFrame) -> DataFrame:
    """Per target group the path with the most failed requests (codes from 400 on) and its most common code."""
    per_code = (paths.filter(F.col("elb_code") >= 400).groupBy("tg", "method", "path_group", "elb_code")
                .agg(F.sum("n").alias("n")))
    per_path = per_code.groupBy("tg", "method", "path_group").agg(
        F.sum("n").alias("n"), F.max_by("elb_code", F.struct("n", "elb_code")).alias("code"))
    best = F.min_by(F.struct("method", "path_group", "code", "n"), F.struct(-F.col("n"), "path_group", "method"))
    return per_path.groupBy("tg").agg(best.alias("e")).select(
        "tg", F.col("e.method").alias("error_method"), F.col("e.path_group").alias("error_path"),
        F.col("e.code").alias("error_code"), F.col("e.n").alias("error_count"))


def target_group_table(rollup: DataFrame, paths: DataFrame | None) -> DataFrame:
    """The table of target groups with their top failing path, most failing first."""
    return _with_top_error(target_groups(rollup), paths)


def _with_top_error(rows: DataFrame, paths: DataFrame | None) -> DataFrame:
    if paths is not None:
        top = top_error_paths(paths).withColumnRenamed("tg", "error_tg")
        rows = rows.join(top, F.col("tg").eqNullSafe(F.col("error_tg")), "left").drop("error_tg")
    return rows.orderBy(F.desc("s5xx"), F.desc("s4xx"), F.desc("requests"), F.coalesce("tg", F.lit("~")))


def summary(query: RequestQuery, tables: RequestTables, step: int) -> dict[str, DataFrame]:
    """The summary page: totals, buckets and target groups out of one pass over the roll-up, or over the days where there are longer steps.

    The pass is kept as ``cells`` (codes x bins per target group, and per bucket where it feeds those too); unpersist it when done. With longer
    steps the buckets are read from the hours on their own, which need no latency bins.
    """
    keys = ["tg", "cluster", "lb"]
    if query.level() == ROWS or (tables.long_minutes if query.level() == MINUTES else tables.long_paths) is None:
        t = floor_to("minute_ms", step)
        kept = cells(query.minutes(tables, step).withColumn("t", t), [*keys, "t"]).persist()
        buckets = kept.filter("t IS NOT NULL").groupBy("t").agg(*_class_sums())
    else:
        kept = cells(query.minutes(tables, None), keys).persist()
        buckets = status_buckets(query.minutes(tables, step), step)
    paths = None if query.domains and query.level() == MINUTES else query.paths(tables, None)
    return {"cells": kept, "totals": _totals(kept), "buckets": buckets,
            "target_groups": _with_top_error(_target_groups(kept), paths)}


def code_counts(rollup: DataFrame) -> DataFrame:
    return (rollup.filter(F.col("elb_code").isNotNull()).groupBy("elb_code")
            .agg(F.sum("n").alias("n"), sum_when("tgt_code IS NOT NULL", "n").alias("app")))


def path_code_counts(paths: DataFrame) -> DataFrame:
    return (paths.filter(F.col("tg").isNotNull()).groupBy("tg", "method", "path_group", "elb_code")
            .agg(F.sum("n").alias("n")))


def path_stats(paths: DataFrame) -> DataFrame:
    """Per method and grouped path: requests, classes, average, p95, first 3 target groups, top code.

    The cells are dealt out by path once; the sums per code, from which the top code is picked, and the sums per path both use that.
    """
    by_path = cells(paths, [*PATH, "tg"]).repartition(*PATH)
    coded = by_path.withColumn("same", F.sum("n").over(W.partitionBy(*PATH, "elb_code")))
    picked = {"tgs": F.slice(F.sort_array(F.collect_set("tg")), 1, 3), "top_code": F.max_by("elb_code", F.struct("same", "elb_code"))}
    return _status(coded, PATH, {"p95": 0.95}, **picked).drop("other", "s5xx_app", "s5xx_lb")


def path_table(paths: DataFrame, sort: str = "errors", limit: int = 50) -> DataFrame:
    """The paths page; ``groups`` is the number of paths over all pages."""
    orders = {"errors": [F.desc("s5xx"), F.desc("s4xx"), F.desc("requests")],
              "slow": [F.desc_nulls_last("p95"), F.desc("requests")]}
    order = orders.get(sort, [F.desc("requests")])
    groups = paths.select(*PATH).distinct().agg(F.count("*"))
    return path_stats(paths).orderBy(*order, "path_group", "method").limit(limit).withColumn("groups", groups.scalar())


def overview(rollup: DataFrame) -> DataFrame:
    """Requests per balancer and target group; balancers without a visible group do not appear."""
    return (rollup.filter(F.col("lb").isNotNull()).groupBy("lb", "tg")
            .agg(F.min("cluster").alias("cluster"), F.sum("n").alias("requests")))


# ---- pages of single requests
def page_hours(counts: DataFrame, offset: int, size: int, descending: bool = True) -> DataFrame:
    """The hours that hold rows [offset, offset + size) of the page order, from (hour_ms, n) counts.

    One row per hour of the range goes into the running total, whatever the number of requests.
    """
    order = F.desc("hour_ms") if descending else F.asc("hour_ms")
    running = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counts.groupBy("hour_ms").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(running))
    return (upto.filter((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + size))
            .withColumn("before", F.col("upto") - F.col("n")))


def hour_counts(query: RequestQuery, tables: RequestTables) -> DataFrame:
    """(hour_ms, n) of the matching requests, from the smallest table that can tell.

    Roll-ups count whole minutes; the requests before the first and after the last whole minute of
    the range are counted from the rows themselves.
    """
    level = query.level()
    first, last = -(-query.start_ms // MINUTE) * MINUTE, (query.end_ms + 1) // MINUTE * MINUTE - 1

    def rows(start: int, end: int) -> DataFrame:
        part = replace(query, start_ms=start, end_ms=end)
        return tables.requests.filter(part.condition(ROWS)).select(floor_to("ts_ms", HOUR).alias("hour_ms"),
                                                                   F.lit(1).cast("bigint").alias("n"))
    if level == ROWS or last < first:
        parts = [rows(query.start_ms, query.end_ms)]
    else:
        whole = replace(query, start_ms=first, end_ms=last)
        parts = [whole.rolled(level, tables, HOUR).select(floor_to("minute_ms", HOUR).alias("hour_ms"), "n")]
        parts += [rows(a, b) for a, b in ((query.start_ms, first - 1), (last + 1, query.end_ms)) if a <= b]
    if tables.unmerged is not None:
        parts.append(tables.unmerged.filter(query.condition(ROWS))
                     .select(floor_to("ts_ms", HOUR).alias("hour_ms"), F.lit(1).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("hour_ms").agg(F.sum("n").alias("n"))


def _all_requests(tables: RequestTables) -> DataFrame:
    return tables.requests if tables.unmerged is None else tables.requests.unionByName(tables.unmerged)


def request_page(query: RequestQuery, tables: RequestTables, size: int = 100, offset: int = 0,
                 descending: bool = True) -> DataFrame:
    """One page of single requests: time order, then trace id.

    The counts per hour name the hours that hold the page; their bounds come back as one row and
    reach the scan as literals, so only those partitions are read and sorted.
    """
    if size <= 0 or offset < 0:
        raise ValueError("a page has at least one row and starts at row 0 or later")
    hours = page_hours(hour_counts(query, tables), offset, size, descending)
    lo, hi, before = hours.agg(F.min("hour_ms"), F.max("hour_ms"), F.min("before")).first()
    rows = _all_requests(tables).filter(query.condition(ROWS))
    if lo is None:
        return rows.limit(0)
    order = [F.desc("ts_ms") if descending else F.asc("ts_ms"), F.asc("trace_id")]
    return (rows.filter(F.col("ts_ms").between(lo, hi + HOUR - 1)).orderBy(*order)
            .offset(offset - before).limit(size))


def slowest(query: RequestQuery, tables: RequestTables, limit: int = 5) -> DataFrame:
    """The requests the targets took longest to answer.

    Where a roll-up can apply all of the query's filters, the highest latency bins that hold ``limit`` of its requests give a
    lower bound for the answer time, which the scan can use; finished hours below it are never read. Other filters (paths,
    clients, words …) are only known from the rows, which are then all compared.
    """
    rows = _all_requests(tables).filter(query.condition(ROWS) & F.col("tgt_t").isNotNull())
    level = query.level()
    if level != ROWS:
        whole = replace(query, start_ms=-(-query.start_ms // MINUTE) * MINUTE,
                        end_ms=(query.end_ms + 1) // MINUTE * MINUTE - 1)
        per_bin = (whole.rolled(level, tables, None).filter(F.col("lat_bin").isNotNull())
                   .groupBy("lat_bin").agg(F.sum("n").alias("n")))
        running = W.orderBy(F.desc("lat_bin")).rowsBetween(W.unboundedPreceding, W.currentRow)   # 24 bins
        enough = per_bin.withColumn("upto", F.sum("n").over(running)).filter(F.col("upto") >= limit)
        lowest = enough.agg(F.max("lat_bin")).first()[0]
        if lowest is not None:
            # a hair below the edge: the bin compared milliseconds, the column holds seconds
            rows = rows.filter(F.col("tgt_t") >= P.LATENCY_EDGES[lowest] / 1000 * (1 - 1e-12))
    return rows.orderBy(F.desc("tgt_t"), F.desc("ts_ms"), "trace_id").limit(limit)
