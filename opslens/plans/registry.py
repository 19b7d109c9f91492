"""Registered queries: name -> (Spark callable, SQL twin or None)."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None


class Registry(dict):
    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def keep(run: Run) -> Run:
            if name in self:
                raise ValueError(f"query '{name}' is registered twice")
            self[name] = Query(lambda spark, sf_dir: run(prepare(spark), sf_dir), sql)
            return run
        return keep
