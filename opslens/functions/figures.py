"""Shares, changes and call-weighted averages."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, NULL of nothing."""
    return F.round(ratio(F.lit(100.0) * part, whole), digits)


def change_pct(now: Column, before: Column) -> Column:
    """Change in percent with one decimal, NULL when there was nothing before."""
    return F.round(ratio(F.lit(100.0) * (now - before), before), 1)


def weighted_avg(value: str, weight: str, where: Column | None = None) -> Column:
    """Average of ``value`` weighted by ``weight``, over the rows that have a value."""
    v, w = F.col(value), F.col(weight)
    present = v.isNotNull() if where is None else v.isNotNull() & where
    total = F.sum(F.when(present, w))
    return F.when(total != 0, F.sum(F.when(present, v * w)) / total)


def sum_when(test: str, value: str = "1") -> Column:
    """Sum over the rows passing an SQL test, 0 when there is none."""
    return F.expr(f"coalesce(sum({value}) FILTER (WHERE {test}), 0)")
