"""Files of one data set whose columns changed their type: joined by name, each column in a type that holds all of its values."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: files of a conflict whose schemas are read one by one
FEW = 64
WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both: the larger integer, double for numbers with fractions, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in WHOLE and b in WHOLE:
        return WHOLE[max(WHOLE.index(a), WHOLE.index(b))]
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        whole, fraction = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
        return T.DecimalType(min(38, whole + fraction), fraction) if whole + fraction <= 38 else T.DoubleType()
    if all(isinstance(t, T.NumericType) for t in (a, b)):
        return T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    return T.StringType()


def joined(a: T.StructType, b: T.StructType) -> T.StructType | None:
    """The columns of both by name, or None if one of them has two types."""
    known = {f.name: f for f in a}
    if any(f.name in known and known[f.name].dataType != f.dataType for f in b):
        return None
    return T.StructType([*a, *[f for f in b if f.name not in known]])


def schema_groups(spark: SparkSession, files: Sequence[str], base: str) -> list[tuple[T.StructType, list[str]]]:
    """``files`` (in order of time) in groups without a conflict, each with its joined schema.

    Spark joins the schemas of many files at once, from their footers; where that fails the files are halved, and looked at one by one when they are few. A column
    changes its type at some time, so few halvings find the places. Groups that go together again are put together.
    """
    groups: list[tuple[T.StructType, list[str]]] = []
    todo = [list(files)]

    def place(schema: T.StructType, part: list[str]) -> None:
        for i, (other, members) in enumerate(groups):
            both = joined(other, schema)
            if both is not None:
                groups[i] = (both, members + part)
                return
        groups.append((schema, part))

    def own(file: str) -> T.StructType:
        return spark.read.option("basePath", base).parquet(file).schema
    while todo:
        part = todo.pop()
        try:
            schema = spark.read.option("mergeSchema", "true").option("basePath", base).parquet(*part).schema
        except Exception as e:  # noqa: BLE001  the conflict comes from the driver or from a task, in different classes
            if len(part) == 1 or "CANNOT_MERGE" not in str(e) and "Failed to merge" not in str(e):
                raise
            if len(part) > FEW:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            else:
                with ThreadPoolExecutor(8) as pool:
                    for file, schema in zip(part, pool.map(own, part), strict=True):
                        place(schema, [file])
            continue
        place(schema, part)
    return groups


def read_widened(spark: SparkSession, files: Sequence[str], base: str) -> DataFrame:
    """All rows of Parquet ``files`` under ``base``, with ``_file`` and ``_row``; each group of one schema is one scan."""
    groups = schema_groups(spark, files, base)
    kinds: dict[str, T.DataType] = {}
    for schema, _ in groups:
        for f in schema:
            kinds[f.name] = widened(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    parts = []
    for schema, members in groups:
        rows = spark.read.schema(schema).option("basePath", base).parquet(*members)
        columns = [F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name) for f in schema]
        parts.append(rows.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*[f"`{n}`" for n in kinds], "_file", "_row")
