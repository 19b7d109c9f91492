"""Importance resampling towards a target corpus by hashed n-gram counts from an overlapped regex scan."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, arrow_pass, free_name, keyed, materialized, stored, texts
from .words import PIECE

#: words of a feature at most, buckets, percent drawn, words of a document that may be drawn at least, seed
WORDS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
#: bytes -> lower-case letters A-Z, digits, and bytes of other than ASCII as they are; all else a space
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: at each start of a word, the spans of three, two and one words from there (at the end as many as there are)
NGRAM = regex.compile(rb"(?<![^ ])((([^ ]++)(?: [^ ]++)?+)(?: [^ ]++)?+)(?![^ ])")
_GROUPS = type(regex.match("", "")).groups


def scan(line: bytes) -> np.ndarray:
    """Buckets of all runs of one to WORDS words of ``line``, words joined by single spaces; the last two words' runs are the last three."""
    crc = np.fromiter(map(zlib.crc32, chain.from_iterable(map(_GROUPS, NGRAM.finditer(line, overlapped=True)))), np.uint32)
    keep = np.ones(len(crc), bool)
    keep[-3:-1] = False  # the last word starts one run, the one before it two
    if len(crc) > 3:
        keep[-6] = False
    return (crc[keep] % BUCKETS).astype("<u2")


def scanned(text: str, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets) of a text, in pieces of about ``piece`` bytes; each run is in the piece where it starts."""
    data = text.encode().translate(PLAIN)
    at, carry = 0, b""
    while True:
        cut = data.find(b" ", at + piece) if len(data) - at > piece else -1
        line = b" ".join([carry, *data[at : cut if cut >= 0 else len(data)].split()] if carry else data[at : cut if cut >= 0 else len(data)].split())
        if cut < 0:
            yield line.count(b" ") + 1 if line else 0, scan(line)
            return
        at = cut + 1
        # what starts at the last two words goes on in the next piece
        words = line.rsplit(b" ", 2)
        carry = b" ".join(words[-2:])
        if len(words) == 3:
            yield words[0].count(b" ") + 1, scan(line)[:-3]


def features(docs: DataFrame, key: str, text: Column | str, piece: int = PIECE) -> DataFrame:
    """ROW, doc_id (``key``), n_words, buckets (16-bit little-endian): a row per piece of a text, one at least."""
    kind = docs.schema[key].dataType.simpleString()

    def start():
        def step(batch: pa.RecordBatch):
            at, n, buckets = [], [], []
            for i, t in enumerate(texts(batch, "text")):
                for words, b in scanned(t, piece):
                    at.append(i)
                    n.append(words)
                    buckets.append(b.tobytes())
            ids = pa.array(at, pa.int64())
            return [*[batch.column(c).take(ids) for c in (*ROW, "doc_id")], pa.array(n, pa.int64()), pa.array(buckets, pa.binary())]
        return step

    rows = keyed(docs, doc_id=key, text=F.col(text).cast("string") if isinstance(text, str) else text)
    return arrow_pass(rows, f"{ROW[0]} long, {ROW[1]} long, doc_id {kind}, n_words long, buckets binary", start, most_bytes=8 << 20)


def bucket_counts(found: DataFrame) -> list[int]:
    """How many features ``found`` has in each bucket; counted in the tasks, then summed: BUCKETS rows come to the driver."""
    class Counter:
        def __init__(self):
            self.counts = np.zeros(BUCKETS, np.int64)

        def __call__(self, batch: pa.RecordBatch):
            for b in batch.column("buckets"):
                self.counts += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=BUCKETS)

        def finish(self):
            some = np.flatnonzero(self.counts)
            return [some, self.counts[some]]

    counts = [0] * BUCKETS
    for bucket, n in arrow_pass(found.select("buckets"), "bucket long, n long", Counter).groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(have: list[int], want: list[int]) -> list[int]:
    """A bucket's gain: floor(1000 * log ratio of its shares in the wanted and the given corpus, one added to each count)."""
    s, t = float(sum(have) + BUCKETS), float(sum(want) + BUCKETS)
    return [math.floor(1000 * math.log((w + 1.0) * s / ((h + 1.0) * t))) for h, w in zip(have, want, strict=True)]


def gumbel(key: str = "doc_id", seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel variate) drawn by a hash of the key: adding it to log weights and taking the greatest samples without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: Column | str = "text", piece: int = PIECE) -> DataFrame:
    """ROW, doc_id (``key``), n_words, n_features, weight: the sum of its features' gains towards ``target`` (column text) for every row of ``docs``."""
    found = stored(features(docs, key, text, piece), "features")
    gain = gains(bucket_counts(found), bucket_counts(features(target.select(F.lit(0).alias("k"), F.col("text").alias("t")), "k", "t", piece)))

    def start():
        table = np.array(gain, np.int64)

        def step(batch: pa.RecordBatch):
            got = [np.frombuffer(b.as_buffer(), "<u2") for b in batch.column("buckets")]
            return [*[batch.column(c) for c in (*ROW, "doc_id", "n_words")], pa.array([len(b) for b in got], pa.int64()), pa.array([int(table[b].sum()) for b in got], pa.int64())]
        return step

    kind = found.schema["doc_id"].dataType.simpleString()
    parts = arrow_pass(found, f"{ROW[0]} long, {ROW[1]} long, doc_id {kind}, n_words long, n_features long, weight long", start)
    return parts.groupBy(*ROW, "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: Column | str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id (``key``), n_words, n_features, weight, score, rank.

    A-Z are lower-cased; words are runs of letters a-z, digits and characters outside ASCII. Features are all runs of one to WORDS words, repeats
    counted; a feature's bucket is its CRC-32 modulo BUCKETS. The weight adds up the gains (see ``gains``) of a row's features, score adds ``gumbel`` of the key. Of the N rows
    with ``least_words`` words or more the floor(percent * N / 100) with the highest scores are drawn and numbered from 1; rank is null for the
    others. Ties go to the smaller key (null last), then to the row that is first in its file. A null or empty text has no features and weight 0. An empty
    ``target`` has no counts; empty ``docs`` give no rows; other columns, whatever their names, are left out.

    Texts are read once; what is written of them is two bytes a feature. Ranks come from a range partitioning: a count per partition goes to the driver, no
    task sees more than its range.
    """
    rows = weighed(docs, target, key, text, piece).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    may = (F.col("n_words") >= least_words).alias("may")
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *[F.col(c).asc() for c in ROW]]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.select("*", may), "scored").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "dealt")
    parts = sorted((p, m, k) for p, m, k in dealt.groupBy("part").agg(F.sum(F.col("may").cast("long")), F.count("*")).collect())
    before, total = [], 0
    for p, m, _ in parts:
        before.append((p, total))
        total += m
    drawn = percent * total // 100
    offsets = docs.sparkSession.createDataFrame(before, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    # one row a shuffle partition
    ranked = dealt.join(F.broadcast(offsets), "part").withColumn("place", place.cast("long"))
    rank = F.when(F.col("may") & (F.col("place") <= drawn), F.col("place"))
    return ranked.select(*ROW, "doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with the column rank (renamed if ``docs`` has it)."""
    docs = materialized(docs)
    a, b, c = (free_name(docs, n) for n in ("row_file_", "row_no_", "rank"))
    drawn = resample(docs, target, **options).where("rank is not null").select(F.col(ROW[0]).alias(a), F.col(ROW[1]).alias(b), F.col("rank").alias(c))
    marked = docs.select("*", F.xxhash64("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b))
    return marked.join(drawn, [a, b]).drop(a, b)
