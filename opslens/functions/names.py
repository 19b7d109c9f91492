"""Names: index names, stores and tenants, session IDs, load balancer ARNs."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import patterns as P
from .web import empty_to_null


def name_from_arn(arn: Column) -> Column:
    """Load balancer or target group name of an ARN, the text itself when it is none."""
    parts = F.split(arn, "/")
    return (F.when(F.contains(arn, F.lit(":loadbalancer/")) & (F.size(parts) >= 3), F.get(parts, F.lit(2)))
            .when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(arn))


def parse_order_index(name: Column) -> Column:
    """struct(tenant, variant, year, month, part) of an order index name; NULL when it is not one."""
    group = lambda n: empty_to_null(F.regexp_extract(name, P.ORDER_INDEX, n))
    return F.when(name.rlike(P.ORDER_INDEX), F.struct(
        group(1).alias("tenant"), group(2).alias("variant"), group(3).cast("int").alias("year"),
        group(4).cast("int").alias("month"), group(5).alias("part")))


def store_of_index(name: Column) -> Column:
    """Store of a session or checkout index, the name itself when the pattern does not fit."""
    return F.coalesce(empty_to_null(F.regexp_extract(name, P.SESSION_INDEX, 1)), name)


def classify_session_id(sid: Column, health_prefix: str,
                        known: Sequence[str] = tuple(P.KNOWN_SESSION_VALUES)) -> Column:
    """Category of a session ID. ``health_prefix`` is what the deployment's own health checks send."""
    return (F.when(sid.isNull(), "missing")
            .when(F.startswith(sid, F.lit("M")), "valid")
            .when(F.startswith(sid, F.lit(health_prefix)), "health")
            .when(sid.isin(list(known)), sid)
            .when(sid == "", "empty")
            .when(F.length(sid) > 256, "missing")
            .when(sid.rlike(r"^[0-9]+\z"), "numbers")
            .when(sid.rlike(P.SESSION_UUID), "uuid")
            .otherwise("other"))


def lookup(key: Column, names: Mapping[str, str]) -> Column:
    """Value of a small fixed mapping, NULL when the key is not in it."""
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def store_name(key: Column, names: Mapping[str, str] | None = None) -> Column:
    """Display name of a store or stage: a given name, else the key without the shop suffix."""
    return F.coalesce(lookup(key, names or {}), F.regexp_replace(key, r"\.myshopify\.com$", ""))


def tenant_name(key: Column, names: Mapping[str, str] | None = None) -> Column:
    """Display name of a tenant: a given name, else the domain's words with capital first letters."""
    base = F.regexp_replace(key, r"\.myshopify\.com$|\.(com|co|net|org|shop|store)$", "")
    words = F.filter(F.split(base, r"[-_.]+"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))),
                                                                F.substring(w, 2, 1_000_000))), " ")
    return F.coalesce(lookup(key, names or {}), empty_to_null(titled), key)


def excluded(tenant: Column, patterns: Sequence[str]) -> Column:
    """Does any of the patterns match somewhere in the tenant name?"""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | tenant.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def page_rank(page: Column) -> Column:
    return F.coalesce(lookup(page, {p: str(i) for i, p in enumerate(P.PAGE_ORDER)}).cast("int"),
                      F.lit(len(P.PAGE_ORDER)))


def category_rank(category: Column) -> Column:
    ranks = {c: str(i) for i, c in enumerate(P.CATEGORY_ORDER)}
    return F.coalesce(lookup(category, ranks).cast("double"), F.lit(P.CATEGORY_ORDER.index("other") - 0.5))
