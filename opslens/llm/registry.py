"""Registered queries of this package: name -> (Spark callable, SQL twin or None)."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import Query

Run = Callable[[SparkSession, str], DataFrame]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package's code to the executors of a session that was started without it (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="opslens-code-"), "opslens.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


class Registry(dict):
    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def keep(run: Run) -> Run:
            if name in self:
                raise ValueError(f"query '{name}' is registered twice")
            self[name] = Query(lambda spark, sf_dir: run(ship(spark), sf_dir), sql)
            return run
        return keep


QUERIES = Registry()
