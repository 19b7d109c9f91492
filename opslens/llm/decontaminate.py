"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, materialized, only_rows, stored

#: what separates words, after lower-casing
GAPS = r"[^\p{L}\p{N}]+"
WORDS, SHARE = 5, 0.8
#: sketches and items up to this many rows are broadcast; larger ones are joined by a shuffle
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def shingles(text: Column, make, n: int = WORDS) -> Column:
    """``make`` of each n adjacent words, in text order; an empty array below n words. The text is split once."""
    def each(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: make(*[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, whole).otherwise(F.slice(whole, 1, 0))
    return F.element_at(F.transform(F.array(words(text)), each), 1)


def shingles_of(text: Column, make, lengths: Sequence[int]) -> Column:
    """The shingles of each of ``lengths`` words."""
    return F.flatten(F.array(*[shingles(text, make, n) for n in lengths]))


def own_shingles(text: Column, make, n: int) -> Column:
    """An item's shingles: of n words, or the one of all its words if it has fewer; none without words."""
    few = F.size(words(text))
    return F.when((few > 0) & (few < n), F.array(F.array_join(words(text), " "))).otherwise(shingles(text, make, n))


def joined_words(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def item_sketches(items: DataFrame, share: float) -> DataFrame:
    """``items`` (item, shingles) with need and sketch: the smallest hashes of its shingles.

    Items are partitioned by size (powers of two). A text that holds ``need`` of an item's n shingles lacks at most n - need, so it
    holds one of any n - need + 1: the sketch length of a partition follows from its largest item, and a search for
    the sketch's hashes finds every text that can reach the share.
    """
    lacking = lambda n: n - F.ceil(F.round(n * F.lit(share), 6))
    sized = items.withColumn("n", F.size("shingles")).where("n > 0").withColumn("class", F.floor(F.log2("n")))
    lengths = sized.groupBy("class").agg(F.max(lacking(F.col("n")) + 1).cast("int").alias("length"))
    hashes = F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s))))
    return (sized.join(lengths, "class").withColumn("need", F.ceil(F.round(F.col("n") * F.lit(share), 6)).cast("int"))
            .withColumn("sketch", F.slice(hashes, 1, F.col("length"))))


def contained_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                    item_text: str = "text", n: int = WORDS, share: float = SHARE) -> DataFrame:
    """A row per row of ``docs`` and item of which it holds at least ``share`` of the distinct n-word shingles.

    Columns: ROW, doc_id, item_id, n_shingles (of the item), n_shared, containment. Words are runs of letters and digits, lower case.
    An item of m < n words is one shingle of m words, looked for among the texts' runs of m words. Texts and items without a word, and texts shorter
    than an item's shingles, are in no row. Items that repeat, also with one id, are found
    each; repeated documents too. Long texts are read whole. An empty table on either side gives an empty result.

    The texts are read once for the sketch hashes (those above the largest sketch hash are dropped before they become rows), and the
    texts with a hit once more for the exact count. Sketches and items are broadcast only up to BROADCAST_ROWS rows.
    """
    docs = materialized(docs)
    raw = keyed(benchmark, item_id=item_key, text=item_text).withColumnsRenamed({ROW[0]: "item_file", ROW[1]: "item_no"})
    few = F.size(words(F.col("text")))
    raw = raw.select("*", F.array_distinct(own_shingles(F.col("text"), joined_words, n)).alias("shingles"), F.least(few, F.lit(n)).alias("length")).drop("text")
    items = stored(item_sketches(raw.withColumnRenamed("length", "words"), share), "items")
    lengths = sorted(r[0] for r in items.select("words").distinct().collect()) or [n]  # n numbers at most
    sketch = stored(items.select("item_file", "item_no", F.explode("sketch").alias("hash")), "sketches")
    bound = sketch.agg(F.max("hash"), F.count("*")).first()
    highest, rows = bound[0], bound[1]
    small = (lambda df: F.broadcast(df)) if rows <= BROADCAST_ROWS else (lambda df: df)
    same_hash = lambda *w: F.xxhash64(joined_words(*w))
    low = F.filter(shingles_of(F.col("text"), same_hash, lengths), lambda h: h <= F.lit(highest if highest is not None else -(2**63)))
    hashes = keyed(docs, text=text).select(*ROW, F.explode(low).alias("hash"))
    hits = stored(hashes.join(small(sketch), "hash").select(*ROW, "item_file", "item_no").distinct(), "hits")
    wanted = hits.join(small(items.select("item_file", "item_no", "item_id", "n", "need", "shingles")), ["item_file", "item_no"])
    texts = keyed(docs, doc_id=key, text=text).join(stored(hits.select(*ROW).distinct(), "hit_rows"), ROW).select(
        *ROW, "doc_id", shingles_of(F.col("text"), joined_words, lengths).alias("own"))
    shared = texts.join(wanted, ROW).withColumn("n_shared", F.size(F.array_intersect("shingles", "own")).cast("long"))
    return shared.where("n_shared >= need").select(
        *ROW, "doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item of ``benchmark`` (see ``contained_items``)."""
    docs = materialized(docs)
    return only_rows(docs, contained_items(docs, benchmark, **options).select(*ROW).distinct(), "left_anti")
