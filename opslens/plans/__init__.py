"""All registered queries."""
from __future__ import annotations

from importlib import import_module

from .registry import Query

AREAS = ["logs", "balancers", "ops", "sessions", "alerts", "tables", "stores"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").QUERIES)
    return found
