"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, free_name, keyed, materialized, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: hexadecimal digits of a document's hash that one histogram resolves, and how many histograms there are
DIGITS, LEVELS = 3, 5
#: tables of sources up to this many rows are broadcast; larger ones are joined by a shuffle
BROADCAST_SOURCES = 10_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with target.

    Sources in code point order, null last, take the ``weights`` in turn. ``share`` of all sizes is dealt out by weight; a target stops at
    ``most`` times its source's size and what is over goes to the others by weight, until none is above. So a target is
    min(most * size, level * weight) for the one level at which the targets add up: sources are filled in the order of size to
    weight, and the level follows from what the full ones leave. Runs over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = (w.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    # the level if this source and all after it are not full; the right one is the first that keeps its source within its cap
    w = w.withColumn("level", (F.col("all") - F.col("full")) / F.col("left"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return w.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def thresholds(items: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """source, whole, border: each item of a source is taken ``whole`` times, and once more if its hash is at most border.

    ``items``: source, hash (hexadecimal), size. ``budgets``: source, source_size, target. A histogram sums sizes by source and the hash's
    first digits; the bucket in which the running sum passes the budget is the boundary, and only its items go into the next
    histogram, which resolves further digits. At the last level a bucket is one hash value; it is taken if that comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = budgets.select("source", whole.cast("long").alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit("").alias("border"))
    for level in range(LEVELS):
        width = DIGITS * (level + 1)
        bounds = small(state.select(F.col("source").alias("s"), "border"), sources)
        inside = items.join(bounds, F.col("source").eqNullSafe(F.col("s")) & (F.substring("hash", 1, DIGITS * level) == F.col("border")))
        sums = inside.groupBy("source", F.substring("hash", 1, width).alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("size").over(running)).withColumnRenamed("source", "s")
        reached = sums.join(small(state, sources), F.col("source").eqNullSafe(F.col("s")))
        limit = F.col("upto") - (F.col("size") / 2 if level == LEVELS - 1 else F.col("size"))
        # the last bucket that begins within the budget holds the boundary
        last = reached.where(limit <= F.col("budget")).groupBy("source").agg(
            F.first("whole").alias("whole"), F.max_by(F.col("budget") - (F.col("upto") - F.col("size")), "bucket").alias("left"), F.max("bucket").alias("border"))
        if level == LEVELS - 1:
            # none of a boundary bucket's hashes taken: all below it are
            state = stored(state.select("source", "whole", F.col("border").alias("prefix")).join(
                last.select(F.col("source").alias("s"), F.col("border").alias("found")), F.col("source").eqNullSafe(F.col("s")), "left")
                .select("source", "whole", F.coalesce("found", "prefix").alias("border")), "borders")
        else:
            state = stored(last.select("source", "whole", F.col("left").alias("budget"), "border"), f"state{level}")
    return state


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
        share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id (``key``), size, source_size, target, taken, copies.

    Size is the number of words (null text: 0), target as in ``source_targets``, taken = copies * size. A source's rows are all taken
    as often as its target holds its whole size, and those with a hash up to a threshold once more, so that the sum comes as near to the target as
    whole rows allow and reruns agree. Null sources are a source of their own. The hash is of the key and the text; rows that agree in both are
    taken alike. Rows of size 0 cost nothing and may be taken too. No sort of documents, and no shuffle of texts: only
    (source, hash, size) is kept, and histograms are summed in the tasks before they are shuffled.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    items = stored(keyed(docs, doc_id=key, source=F.col(source).cast("string"), size=size, hash=F.substring(digest, 1, DIGITS * LEVELS)), "items")
    sizes = stored(items.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    sources = sizes.count()
    budgets = stored(source_targets(sizes, weights, share, most), "targets")
    found = small(budgets.join(small(thresholds(items, budgets, sources).withColumnRenamed("source", "s"), sources), F.col("source").eqNullSafe(F.col("s"))).drop("source"), sources)
    joined = items.join(found, F.col("source").eqNullSafe(F.col("s")))
    copies = F.least(F.col("whole") + (F.col("hash") <= F.col("border")).cast("long"), F.lit(int(most)).cast("long"))
    return joined.select(*ROW, "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the column copies (how often; renamed if ``docs`` has it)."""
    docs = materialized(docs)
    a, b, c = (free_name(docs, n) for n in ("row_file_", "row_no_", "copies"))
    taken = mix(docs, **options).where("copies > 0").select(F.col(ROW[0]).alias(a), F.col(ROW[1]).alias(b), F.col("copies").alias(c))
    marked = docs.select("*", F.xxhash64("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b))
    return marked.join(taken, [a, b]).drop(a, b)
