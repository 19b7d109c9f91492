"""Log search: a query compiled to one predicate, and the views of its matches."""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..functions import patterns as P
from ..functions.text import contains_text, like_pattern, true_or_false
from ..functions.times import floor_to, zone_text

LEVEL_OF_NULL = "OTHER"
REF = ["_file", "_row"]


class QueryError(ValueError):
    """A search or filter that can't be answered: unknown field, wrong value, unknown operator."""


@dataclass(frozen=True)
class Filter:
    """field + one of is, is_not, one_of, not_one_of, contains, not_contains, exists, not_exists, gte, lte, between."""
    field: str
    op: str
    value: Any = None
    values: Sequence[Any] = ()
    gte: Any = None
    lte: Any = None


@dataclass(frozen=True)
class LogQuery:
    """Time range (both ends inclusive), free text and filters; all conditions must hold."""
    start_ms: int | None = None
    end_ms: int | None = None
    text: str = ""
    filters: Sequence[Filter] = field(default_factory=tuple)

    def apply(self, logs: DataFrame) -> DataFrame:
        return logs.filter(self.condition(logs.schema))

    def condition(self, schema: T.StructType) -> Column:
        compiler = _Compiler({f.name: f.dataType for f in schema.fields})
        parts = [*compiler.time(self.start_ms, self.end_ms), *compiler.words(self.text),
                 *(compiler.filter(f) for f in self.filters)]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


class _Compiler:
    def __init__(self, fields: dict[str, T.DataType]):
        self.fields = fields
        self.text_columns = [c for c in P.TEXT_COLUMNS if c in fields and not isinstance(fields[c], T.NumericType)]

    # -- values
    def typed(self, name: str, value: Any) -> Any:
        kind = self.kind(name)
        text = str(value).strip()
        if isinstance(kind, T.BooleanType):
            if text.lower() not in ("true", "false"):
                raise QueryError(f"'{name}' is true or false")
            return text.lower() == "true"
        if isinstance(kind, T.NumericType):
            whole = isinstance(kind, T.IntegralType)
            try:
                return int(text) if whole else float(value)
            except (TypeError, ValueError):
                raise QueryError(f"'{name}' holds numbers; {value!r} is not a number") from None
        return str(value)

    def kind(self, name: str) -> T.DataType:
        if name not in self.fields:
            raise QueryError(f"there is no column '{name}' in these logs")
        return self.fields[name]

    # -- conditions
    def time(self, start_ms: int | None, end_ms: int | None) -> Iterable[Column]:
        if "log_time_ms" in self.fields:
            t = F.col("log_time_ms")
            if start_ms is not None:
                yield t >= F.lit(start_ms)
            if end_ms is not None:
                yield t <= F.lit(end_ms)

    def words(self, text: str) -> Iterable[Column]:
        for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or ""):
            # a lone '-' and a quote inside a word are plain text
            name, _, value = word.partition(":")
            if word and value and name in self.fields:
                hit = self.field_word(name, value)
            elif word or phrase:
                hit = self.anywhere(word or phrase)
            else:
                continue
            yield ~hit if sign else hit

    def anywhere(self, needle: str) -> Column:
        if not self.text_columns:
            raise QueryError("these logs have no text columns to search")
        return reduce(lambda a, b: a | b, [true_or_false(contains_text(F.col(c).cast("string"), needle))
                                           for c in self.text_columns])

    def field_word(self, name: str, value: str) -> Column:
        if len(value) >= 2 and value[0] == value[-1] == '"':
            value = value[1:-1]
        if isinstance(self.kind(name), (T.NumericType, T.BooleanType)):
            return true_or_false(F.col(name) == F.lit(self.typed(name, value)))
        return true_or_false(F.col(name).ilike(like_pattern(value)))

    def filter(self, f: Filter) -> Column:
        self.kind(f.field)
        c = F.col(f.field)
        positive = f.op.replace("not_", "", 1) if f.op.startswith("not_") else f.op.removesuffix("_not")
        if positive == "exists":
            return c.isNull() if f.op == "not_exists" else c.isNotNull()
        if positive in ("gte", "lte", "between"):
            return self.bounds(f, c)
        if positive == "is":
            if f.value is None:
                raise QueryError(f"'{f.field} {f.op}' needs a value")
            hit = c == F.lit(self.typed(f.field, f.value))
        elif positive == "one_of":
            if not f.values:
                raise QueryError(f"'{f.field} {f.op}' needs a value")
            hit = c.isin([self.typed(f.field, v) for v in f.values])
        elif positive == "contains":
            if not str(f.value or ""):
                raise QueryError(f"'{f.field} {f.op}' needs a value")
            hit = contains_text(c.cast("string"), str(f.value))
        else:
            raise QueryError(f"unknown filter operator '{f.op}'")
        hit = true_or_false(hit)
        return hit if positive == f.op else ~hit

    def bounds(self, f: Filter, c: Column) -> Column:
        low = f.gte if f.op != "lte" else None
        high = f.lte if f.op != "gte" else None
        if f.op == "gte" and f.value is not None:
            low = f.value
        if f.op == "lte" and f.value is not None:
            high = f.value
        parts = [c >= F.lit(self.typed(f.field, low))] if low not in (None, "") else []
        parts += [c <= F.lit(self.typed(f.field, high))] if high not in (None, "") else []
        if not parts:
            raise QueryError(f"'{f.field} {f.op}' needs a value")
        return reduce(lambda a, b: a & b, parts)


# ---- views of the matches
def with_row_ref(logs: DataFrame) -> DataFrame:
    """File and row number of every row: the key of the detail view."""
    if set(REF) <= set(logs.columns):
        return logs
    return logs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def ensure_columns(logs: DataFrame, names: Sequence[str], kind: str = "string") -> DataFrame:
    """Columns the files do not have, as NULLs."""
    missing = [n for n in names if n not in logs.columns]
    return logs.withColumns({n: F.lit(None).cast(kind) for n in missing}) if missing else logs


def count_matches(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("total"))


def histogram(matches: DataFrame, step: int) -> DataFrame:
    """(t, level, n) per bucket and upper-case level."""
    level = F.coalesce(F.upper("level"), F.lit(LEVEL_OF_NULL))
    return (matches.filter(F.col("log_time_ms").isNotNull())
            .groupBy(floor_to("log_time_ms", step).alias("t"), level.alias("level"))
            .agg(F.count("*").alias("n")))


def histogram_buckets(matches: DataFrame, step: int) -> DataFrame:
    """(t, count, levels map): the chart's buckets."""
    per_level = F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n"))))
    return (histogram(matches, step).groupBy("t")
            .agg(F.sum("n").alias("count"), per_level.alias("levels")))


def facets(matches: DataFrame, columns: Sequence[str] = tuple(P.FACET_COLUMNS), limit: int = 8) -> DataFrame:
    """(field, value, n, rank): the most frequent values of several columns from one pass over the matches.

    The rank filter lets Spark cut each task's values to ``limit`` before they are shuffled by field.
    """
    present = [c for c in columns if c in matches.columns]
    counts = (matches.select([F.col(c).cast("string").alias(c) for c in present])
              .unpivot([], present, "field", "value").filter(F.col("value").isNotNull())
              .groupBy("field", "value").agg(F.count("*").alias("n")))
    best = W.partitionBy("field").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


#: pages up to this many rows are broadcast
BROADCAST_PAGE = 1000


def page(matches: DataFrame, size: int, offset: int = 0, descending: bool = True,
         keys: Sequence[str] = ("log_time_ms", *REF)) -> DataFrame:
    """One page in (time, file, row) order.

    Only the key columns are sorted; the page's full rows are then read by their keys. A page of up to
    BROADCAST_PAGE rows is looked up by a broadcast, a longer one by a join that Spark chooses. ``page_after``
    makes deep pages cheap.
    """
    if size <= 0 or offset < 0:
        raise QueryError("a page has at least one row and starts at row 0 or later")
    keys = [k for k in keys if k in matches.columns]
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    wanted = matches.select(*keys).orderBy(*order).offset(offset).limit(size)
    ref = [k for k in keys if k != "log_time_ms"]
    looked_up = F.broadcast(wanted.select(*ref)) if size <= BROADCAST_PAGE else wanted.select(*ref)
    return matches.join(looked_up, ref, "left_semi").orderBy(*order)


def page_after(matches: DataFrame, size: int, last: Sequence[Any] | None, descending: bool = True,
               keys: Sequence[str] = ("log_time_ms", *REF)) -> DataFrame:
    """The page after the row whose keys are ``last``: cost does not grow with the depth of the page."""
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    if last is not None:
        here = F.struct(*keys)
        there = F.struct(*[F.lit(v).cast(matches.schema[k].dataType).alias(k) for k, v in zip(keys, last)])
        matches = matches.filter(here < there if descending else here > there)
    return matches.orderBy(*order).limit(size)


def ordered_columns(columns: Sequence[str]) -> list[str]:
    """Preferred names first, the rest in file order."""
    return [c for c in P.FIRST_COLUMNS if c in columns] + [c for c in columns if c not in P.FIRST_COLUMNS]


def truncate_cells(df: DataFrame, chars: int = P.CELL_CHARS) -> DataFrame:
    """Text cut to ``chars`` characters, and whether anything was cut."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > chars, F.lit(False)) for c in texts], F.lit(False))
    cut = {c: F.left(c, F.lit(chars)) for c in texts}
    return df.select(*[cut[c].alias(c) if c in cut else F.col(c) for c in df.columns], long.alias("_truncated"))


def record(logs: DataFrame, root: str, file: str, row: int) -> DataFrame:
    """One full row by its reference; the file has to be inside the cluster's folder."""
    if ".." in file or not file.endswith(".parquet") or not file.startswith(root.rstrip("/") + "/"):
        raise QueryError("that reference does not belong to this cluster")
    return with_row_ref(logs).filter((F.col("_file") == file) & (F.col("_row") == row))


def export_rows(matches: DataFrame, columns: Sequence[str] | None, limit: int | None = None, descending: bool = True,
                zone: str | None = None, keys: Sequence[str] = ("log_time_ms", *REF)) -> DataFrame:
    """All rows, or the first ``limit``, in page order; ``log_time`` written in a zone with its offset."""
    keys = [k for k in keys if k in matches.columns]
    names = list(columns) if columns else ordered_columns([c for c in matches.columns if c not in REF])
    unknown = [n for n in names if n not in matches.columns]
    if unknown:
        raise QueryError(f"there is no column '{unknown[0]}' in these logs")
    rows = matches.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys])
    rows = rows if limit is None else rows.limit(limit)
    if zone and "log_time_ms" in matches.columns and "log_time" in names:
        rows = rows.withColumn("log_time", zone_text(F.col("log_time_ms"), zone))
    return rows.select(*names)
