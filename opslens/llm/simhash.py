"""Near duplicates by SimHash fingerprints, linked through vantage-point trees."""
from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_pass, keyed, materialized, only_rows, stored, texts
from .components import components
from .hamming_trees import hamming_links
from .words import word_lists

#: words of a shingle, seed of its hash, bits in which linked fingerprints differ at most
WORDS, SEED, BITS = 3, 42, 3


def set_bits(shingles: Iterable[bytes]) -> np.ndarray:
    """How many of the shingles' hashes have each of the 64 bits set, lowest bit first."""
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    return np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(data: bytes) -> int:
    """The SimHash of a text in UTF-8 as a signed 64-bit integer; long texts are read in pieces."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_lists(data.lower()):  # bytes.lower() changes A-Z only
        words = tail + words
        ones += set_bits(map(b" ".join, zip(*[words[i:] for i in range(WORDS)], strict=False)))
        n += max(0, len(words) - WORDS + 1)
        tail = words[-(WORDS - 1) :]
    if not n and tail:
        ones, n = set_bits([b" ".join(tail)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """ROW, doc_id (``key``), fp: the SimHash of every row's text."""
    kind = docs.schema[key].dataType.simpleString()

    def start():
        def step(batch: pa.RecordBatch):
            return [*[batch.column(c) for c in (*ROW, "doc_id")], pa.array([fingerprint(t.encode()) for t in texts(batch, "text")], pa.int64())]
        return step

    rows = keyed(docs, doc_id=key, text=F.col(text).cast("string") if isinstance(text, str) else text)
    return arrow_pass(rows, f"{ROW[0]} long, {ROW[1]} long, doc_id {kind}, fp long", start)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: Column | str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id (``key``), fp (long), component_id.

    A-Z are lower-cased; shingles are WORDS words ``[^\\x20\\x09-\\x0D]+`` in a row, repeats included, joined by a space (fewer words: all of them). A bit
    of the fingerprint is 1 if more than half of the shingles' XXH64 values have it; a null or empty text, or one without a word, has fingerprint
    zero and is linked like any other. Fingerprints that differ in at most ``bits`` bits are linked; component_id is the smallest key that links reach, itself included
    (null keys don't count; null if there is no other). Rows that repeat share a component; other columns, whatever their names, are left out; an empty table gives no rows.

    Equal fingerprints are one row before they are compared, so that copies cost nothing. Trees, shards and components see distinct fingerprints only.
    """
    found = stored(fingerprints(docs, key, text), "fingerprints")
    prints = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    labels = components(hamming_links(prints, bits))
    classed = stored(prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("class")), "classed")
    heads = stored(classed.groupBy("class").agg(F.min("least").alias("component_id")), "heads")
    named = stored(classed.join(heads, "class").select("fp", "component_id"), "named")
    return found.join(named, "fp").select(*ROW, "doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the row of the smallest key of each component (see ``simhash_components``); of equal keys the first in its file, null keys last."""
    docs = materialized(docs)
    found = stored(simhash_components(docs, **options), "found")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)
    # rows without a key in a component without any are told apart by the fingerprint
    kept = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(F.min(first).alias("first"))
    return only_rows(docs, kept.select(*[F.col(f"first.{c}").alias(c) for c in ROW]))
