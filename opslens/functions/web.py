"""URLs, path groups, status classes and latency bins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import patterns as P


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def url_path(url: Column) -> Column:
    """Path of an absolute URL, or of one that starts with '/'; '/' when there is none."""
    absolute = empty_to_null(F.regexp_extract(url, P.URL_AFTER_HOST, 1))
    relative = F.when(F.startswith(url, F.lit("/")), F.regexp_extract(url, r"^[^?#]*", 0))
    return F.coalesce(absolute, relative, F.lit("/"))


def url_query(url: Column) -> Column:
    return empty_to_null(F.regexp_extract(url, r"\?([^#]*)", 1))


def path_group(path: Column) -> Column:
    """Stores, UUIDs, long hex ids and numbers of a path replaced by placeholders."""
    for pattern, replacement in P.PATH_GROUPS:
        path = F.regexp_replace(path, pattern, replacement)
    return path


def short_path(path: Column) -> Column:
    """Path without its query, ids and numbers as '/…'."""
    return F.regexp_replace(F.substring_index(path, "?", 1), P.SHORT_PATH, "/…")


def cluster_of(tg: Column) -> Column:
    """The cluster a target group is named after: 'tg-x' -> 'x', anything else is its own name."""
    return F.when(F.startswith(tg, F.lit("tg-")), F.substring(tg, 4, 1_000_000)).otherwise(tg)


# ---- status codes
def class_test(status_class: str, code: str = "elb_code") -> str:
    """SQL test of a status class: 2xx … 5xx are n00 to n99; 'other' is no code, below 200 or from 600 on."""
    if status_class == "other":
        return f"({code} IS NULL OR {code} < 200 OR {code} >= 600)"
    if status_class not in P.STATUS_CLASSES:
        raise ValueError("status classes are 2xx, 3xx, 4xx, 5xx or other")
    return f"{code} BETWEEN {status_class[0]}00 AND {status_class[0]}99"


def code_matches(code: Column, codes: Sequence[str]) -> Column:
    """Does a code match one of ['400', '5xx', …]? False for no code."""
    singles = [int(c) for c in codes if not c.endswith("xx")]
    hundreds = [int(c[0]) for c in codes if c.endswith("xx")]
    hit = F.lit(False)
    if singles:
        hit = hit | code.isin(singles)
    if hundreds:
        hit = hit | F.floor(code / 100).isin(hundreds)
    return F.coalesce(hit, F.lit(False))


def codes_overlap(a: Sequence[str], b: Sequence[str]) -> bool:
    """Do two code lists share a code? '4xx' covers '400'."""
    def covers(x: str, y: str) -> bool:
        return x == y or (x.endswith("xx") and x[0] == y[0])
    return any(covers(x, y) or covers(y, x) for x in a for y in b)


# ---- latency bins
_LOWER = "array(" + ", ".join(f"{e}D" for e in P.LATENCY_EDGES) + ")"
_UPPER = "array(" + ", ".join(f"{e}D" for e in P.LATENCY_EDGES[1:] + P.LATENCY_EDGES[-1:]) + ")"


def latency_bin(seconds: str) -> Column:
    """Index of the bin a response time falls in, NULL for no time. Five comparisons by halving, within generated code."""
    def among(low: int, high: int) -> str:
        if low == high:
            return str(low - 1)
        mid = (low + high) // 2
        return f"IF({seconds} * 1000 >= {P.LATENCY_EDGES[mid]}D, {among(mid + 1, high)}, {among(low, mid)})"
    return F.expr(f"CAST(CASE WHEN {seconds} IS NOT NULL THEN {among(0, len(P.LATENCY_EDGES))} END AS TINYINT)")


def bin_list(lat_bin: str = "lat_bin", n: str = "n") -> Column:
    """Aggregate: the counted bins of a group in order, at most one entry per bin of the fixed scale."""
    return F.expr(f"sort_array(collect_list(CASE WHEN {lat_bin} IS NOT NULL THEN named_struct('lat_bin', {lat_bin}, "
                  f"'n', {n}) END))")


def bin_percentile(bins: str, p: float) -> Column:
    """Percentile in seconds from a bin list: linear inside the first bin that reaches p of the total.

    The last bin is open, so it answers with its lower edge. No counts give NULL.
    """
    want = f"{p}D * aggregate({bins}, 0L, (total, b) -> total + b.n)"
    inside = (f"get({_LOWER}, CAST(b.lat_bin AS INT)) + (get({_UPPER}, CAST(b.lat_bin AS INT)) - "
              f"get({_LOWER}, CAST(b.lat_bin AS INT))) * ({want} - acc.seen) / b.n")
    return F.expr(f"""
        aggregate(filter({bins}, b -> b.n > 0), named_struct('seen', 0L, 'ms', CAST(NULL AS DOUBLE)),
                  (acc, b) -> named_struct('seen', acc.seen + b.n, 'ms',
                     CASE WHEN acc.ms IS NULL AND acc.seen + b.n >= {want} THEN {inside} ELSE acc.ms END),
                  acc -> acc.ms / 1000)""")
