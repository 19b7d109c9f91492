"""Helpers shared by the corpus operators: row identity, written intermediate tables, Arrow passes over texts."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: The identity of a row in its file: (hash of the file's path, position in the file).
ROW = ["_row_file", "_row_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """``columns`` of every row plus ROW, which tells apart rows that are equal in every column.

    A table read from files takes the identity from the file; any other frame is written first, so that two
    scans of it agree. Other columns of ``docs``, whatever their names, are left out.
    """
    wanted = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    clash = "_metadata" in {c.lower() for c in docs.columns}
    rows = [F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1])]
    if not clash:
        try:
            return docs.select(*rows, *wanted)
        except AnalysisException:
            pass
    written = stored(docs.select(*wanted), "rows")
    return written.select(*rows, *[F.col(n) for n in columns])


def materialized(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read from files with row positions, else a written copy: for stages that scan it twice."""
    if "_metadata" in {c.lower() for c in docs.columns}:
        names = docs.columns
        return stored(docs.toDF(*[f"c{i}" for i in range(len(names))]), "docs")
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return stored(docs, "docs")


def only_rows(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose identity is (``left_semi``) or is not (``left_anti``) among ``rows``.

    ``docs`` must come from ``materialized``. Columns keep their names and order.
    """
    a, b = (free_name(docs, n) for n in ("row_file_", "row_no_"))
    marked = docs.select("*", F.xxhash64("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b))
    keys = rows.select(F.col(ROW[0]).alias(a), F.col(ROW[1]).alias(b))
    return marked.join(keys, [a, b], how).drop(a, b)


def free_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` into the session's number of shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


#: bytes of a batch that a pass with much memory a byte works on at a time
PIECE = 8 << 20


def pieces(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most_bytes``, or of one row."""
    rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
    todo = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
    while todo:
        part = todo.pop()
        if part.nbytes > 2 * most_bytes and part.num_rows > 1:
            todo += [part.slice(part.num_rows // 2), part.slice(0, part.num_rows // 2)]
        else:
            yield part


def arrow_pass(df: DataFrame, schema: str | StructType, start: Callable[[], Callable[[pa.RecordBatch], Any]], most_bytes: int | None = None) -> DataFrame:
    """``start()`` is called once per task and gives the function that turns a batch into columns (a list of arrays).

    The function may return None for no rows. A ``finish`` attribute, if any, is called after the last batch. Batches
    are cut to ``most_bytes``, if given.
    """
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names

    def made(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in (batch,) if most_bytes is None else pieces(batch, most_bytes):
                columns = step(part)
                if columns is not None:
                    yield made(columns)
        finish = getattr(step, "finish", None)
        columns = finish() if finish else None
        if columns is not None:
            yield made(columns)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def plain(values: pa.Array) -> np.ndarray:
    """A numeric column without nulls as numpy."""
    return values.to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n+1 offsets of its rows in them; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every bit of uint64 values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x
