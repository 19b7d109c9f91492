"""Exact duplicates by deterministic block naming: equal texts get equal names, different texts different ones."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, materialized, only_rows, spread, stored

#: code points in a block
BLOCK = 4096
#: where a block or a pair stands: its row, its number in the row and the row's last number
PLACE = [*ROW, "part", "last"]
PLACE_TYPES = ["long", "long", "int", "int"]
PLACES = ", ".join(f"{n} array<{t}>" for n, t in zip(PLACE, PLACE_TYPES, strict=True))


def _gathered(cut: Callable[[pa.RecordBatch], tuple[list[str], list[np.ndarray]]]):
    """Contents of a batch, equal ones as one row with the list of their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, places = cut(batch)
            seen: dict[str, int] = {}
            code = np.fromiter((seen.setdefault(c, len(seen)) for c in contents), np.int64, len(contents))
            order = np.argsort(code, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(seen)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(p[order])) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *lists], ["content", *PLACE])
    return run


def _blocks(block: int):
    """The blocks of a batch of texts; an empty text is one empty block."""
    def cut(batch: pa.RecordBatch):
        contents, row, part, last = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            cuts = range(0, max(1, len(text)), block)
            contents += [text[a : a + block] for a in cuts]
            row += [i] * len(cuts)
            part += range(len(cuts))
            last += [len(cuts) - 1] * len(cuts)
        row = np.array(row, np.int64)
        ids = [batch.column(n).to_numpy()[row] if len(row) else np.zeros(0, np.int64) for n in ROW]
        return contents, [*ids, np.array(part, np.int32), np.array(last, np.int32)]
    return cut


def _pairs(batch: pa.RecordBatch):
    return batch.column("content").to_pylist(), [batch.column(n).to_numpy() for n in PLACE]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads a partition sorted by content; each new content gets the next number; places are unpacked again."""
    from pyspark import TaskContext

    name, previous = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        names = np.empty(batch.num_rows, np.int64)
        for i, content in enumerate(batch.column("content").to_pylist()):
            if content != previous:
                name, previous = name + 1, content
            names[i] = name
        lists = [batch.column(n) for n in PLACE]
        sizes = np.diff(lists[0].offsets.to_numpy())
        yield pa.RecordBatch.from_arrays([*[x.flatten() for x in lists], pa.array(np.repeat(names, sizes))], [*PLACE, "name"])


def named(gathered: DataFrame) -> DataFrame:
    """PLACE and name: each partition's contents are sorted and numbered, so that equal contents, and only they, share a name.

    Equal contents of a batch travel as one row with their places: a content that a third of all rows have arrives as one
    row per batch. The sorted partition is read as a stream.
    """
    flat = ", ".join(f"{n} {t}" for n, t in zip(PLACE, PLACE_TYPES, strict=True))
    return stored(spread(gathered, "content").sortWithinPartitions("content").mapInArrow(_numbered, f"{flat}, name long"), "names")


def identities(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """ROW, level, name of ``rows`` (ROW and text): two agree in level and name exactly if their texts are equal.

    Texts are cut into blocks, which get integer names in sort order. Then adjacent names are paired and the pairs named, level by
    level, until each text has one name; it leaves with the level at which that is so. A level halves the rows. Null counts as empty.
    """
    texts = rows.select(*ROW, F.coalesce("text", F.lit("")).alias("text"))
    names = named(texts.mapInArrow(_gathered(_blocks(block)), f"content string, {PLACES}"))
    level, done = 0, None
    while True:
        finished = names.where("last = 0").select(*ROW, F.lit(level).alias("level"), "name")
        done = finished if done is None else done.unionByName(finished)
        rest = names.where("last > 0")
        if rest.isEmpty():
            return done
        half = F.expr("part div 2").cast("int").alias("part")
        pairs = rest.groupBy(*ROW, half).agg(F.min_by("name", "part").alias("a"), F.max_by("name", "part").alias("b"), F.count("*").alias("n"), F.max("last").alias("last"))
        contents = pairs.select(F.expr("concat_ws(' ', a, if(n > 1, b, null))").alias("content"), *ROW, "part", F.expr("last div 2").cast("int").alias("last"))
        names, level = named(contents.mapInArrow(_gathered(_pairs), f"content string, {PLACES}")), level + 1


def duplicates(docs: DataFrame, key: str = "doc_id", text: Column | str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id (``key``), keep_id, group_size, kept, text_sha256.

    Rows with equal texts form a group, of which the row with the largest key stays; null keys are smallest, and of
    rows that agree in key and text one stays (the last in its file). Null texts count as empty, and all empty
    texts are one group. Other columns of ``docs`` don't matter. Very long texts are cut into blocks; no row holds
    more than a batch. An empty table gives an empty result.
    """
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text.cast("string"), F.lit(""))
    source = materialized(docs)
    facts = keyed(source, doc_id=key, text_sha256=F.sha2(text, 256))
    whole = stored(facts.join(identities(keyed(source, text=text), block), ROW), "identities")
    groups = whole.groupBy("level", "name").agg(F.max(F.struct("doc_id", *ROW)).alias("keep"), F.count("*").alias("group_size"))
    joined = whole.join(stored(groups, "groups"), ["level", "name"])
    return joined.select(*ROW, "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                         ((F.col(ROW[0]) == F.col(f"keep.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"keep.{ROW[1]}"))).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (see ``duplicates``)."""
    docs = materialized(docs)
    return only_rows(docs, duplicates(docs, key, text).where("not kept"), "left_anti")
