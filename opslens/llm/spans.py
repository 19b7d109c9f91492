"""Spans found in texts, and the digest columns that the queries derive from them."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, texts

Span = tuple[str, int, int]
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def span_rows(docs: DataFrame, key: str, text: str, start: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int, bool]]]]]) -> DataFrame:
    """doc_id (``key``) and spans of every row of ``docs``; ``start()`` gives the function from texts to their spans."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def begin():
        find = start()

        def step(batch: pa.RecordBatch):
            found = find(texts(batch, "text"))
            return [batch.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found], pa.list_(item))]
        return step

    return arrow_pass(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}", begin)


def listed(spans, kinds: Sequence[str], kind_first: bool):
    """kind:start:end of ``spans``, comma-joined; by kind as listed then start, or by start then kind."""
    rank = {k: i for i, k in enumerate(kinds)}
    order = (lambda s: (rank[s["kind"]], s["start"])) if kind_first else (lambda s: (s["start"], rank[s["kind"]]))
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=order))


def digest(found: DataFrame, kinds: Sequence[str], base_kinds: Sequence[str], kind_first: bool) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and spans (text) of a frame with doc_id and spans."""
    key = found.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in base_kinds)

    def begin():
        def step(batch: pa.RecordBatch):
            rows = batch.column("spans").to_pylist()
            base = [[s for s in r if s["base"]] for r in rows]
            numbers = [pa.array([sum(s["kind"] == k for s in r) for r in base], pa.int64()) for k in base_kinds]
            sha = [hashlib.sha256(listed(r, kinds, kind_first).encode()).hexdigest() for r in base]
            return [batch.column("doc_id"), *numbers, pa.array(sha, pa.string()), pa.array([listed(r, kinds, kind_first) for r in rows], pa.string())]
        return step

    return arrow_pass(found, f"doc_id {key}, {counts}, base_sha256 string, spans string", begin)
