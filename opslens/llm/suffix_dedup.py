"""Repeated byte strings by common-prefix interval trees over enhanced suffix arrays.

A string of LENGTH bytes holds an anchor: a gram of GRAM bytes whose hash is the smallest of the string's grams. Equal strings have equal anchors at equal
places, so repeats are found among the occurrences of one anchor gram alone: the suffixes that begin at the anchors are sorted, and a stack-scan over their
common prefixes gives the interval tree; within an interval, the texts to the left are sorted and scanned alike, which tells the left-diverse
extensions, that is the maximal repeats with all their occurrences.

1. Each task finds the anchors of its texts, with a hash of all that a string around the anchor can reach (the surroundings).
2. The anchors meet by gram. Of equal surroundings only the first occurrence matters further; all later ones are removed whole.
3. Grams with different surroundings get the bytes of those first occurrences, and the interval tree finds what they share.
   Grams with more than GROUP different surroundings are too large for one task; their strings are compared one by one in an aggregate.
4. What was found is put together for each text.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE, ROW, arrow_pass, keyed, materialized, mixed, spread, stored, text_bytes

LENGTH, GRAM = 100, 32
#: bytes that a string of LENGTH can have before the anchor; its grams
LEFT = LENGTH - GRAM
GROUP = 20_000
#: bytes hashed at a time
SEGMENT = 1 << 17

_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT + 1024, _BASE, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT + 1024, pow(_BASE, -1, 2**64), np.uint64)])
#: order of a text (its key) and its row; a place is an anchor's position with its reach, or minus one minus a removed span's start
KEYS = ["ord", "packed"]
ANCHOR_SCHEMA = "h long, c long, ord long, packed long, place long"


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each LEFT + 1 adjacent values."""
    span = 1
    while span * 2 <= LEFT + 1:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = LEFT + 1 - span
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, text number, gram hash, surroundings' hash, bytes before and after (within the text) of every anchor of the texts in ``data``."""
    n = len(data)
    valid = np.ones(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(a, b - LENGTH + 1) : b] = False
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, n - LENGTH + 1), SEGMENT):
        count = min(SEGMENT, n - LENGTH + 1 - a)
        lo, hi = max(0, a - LEFT), min(n, a + count + LEFT + LENGTH)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data[lo:hi]] * _POWER[: hi - lo])])
        first = a - lo
        grams = mixed((sums[first + GRAM : first + GRAM + count + LEFT] - sums[first : first + count + LEFT]) * _INVERSE[first : first + count + LEFT]) | np.uint64(1)
        least = np.where(valid[a : a + count], _sliding(grams, np.minimum), np.uint64(0))
        pad = np.zeros(LEFT, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), np.maximum) == grams)
        p = a + at
        text = np.searchsorted(offsets, p, "right") - 1
        left, right = np.minimum(LEFT, p - offsets[text]), np.minimum(LENGTH, offsets[text + 1] - p)
        s, e = p - left - lo, p + right - lo
        around = mixed(((sums[e] - sums[s]) * _INVERSE[s]) ^ ((left << 8 | right).astype(np.uint64) * np.uint64(_BASE)))
        found.append((p, text, grams[at].view(np.int64), around.view(np.int64), left, right))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    keep = np.unique(columns[0], return_index=True)[1]
    return tuple(c[keep] for c in columns)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; touching spans are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[new[1:], True]]


def _find_anchors():
    """Anchors of a batch of texts; of those that agree in gram and surroundings the first, the others as removed spans."""
    def step(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        p, text, h, c, left, right = anchors(data, offsets)
        order, packed = (batch.column(k).to_numpy() for k in KEYS)
        o = np.lexsort((p, packed[text], order[text], c, h))
        p, text, h, c, left, right = (x[o] for x in (p, text, h, c, left, right))
        later = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])] if len(h) else np.zeros(0, bool)
        # texts are set one byte apart, so that runs don't cross them
        s, e = merged((p - left + text)[later], (p + right + text)[later])
        of = np.searchsorted(offsets + np.arange(len(offsets)), s, "right") - 1
        shift = offsets[of] + of
        first = ~later
        p, text, left, right = (x[first] for x in (p, text, left, right))
        place = ((p - offsets[text]) << 16) | (left << 8) | right
        return [np.r_[h[first], mixed((packed[of] + s).astype(np.uint64)).view(np.int64)], np.r_[c[first], e - shift], np.r_[order[text], order[of]], np.r_[packed[text], packed[of]], np.r_[place, -1 - (s - shift)]]
    return step


class Grams:
    """Reads anchors sorted by gram, surroundings and order: the later of equal surroundings become removed spans, and the first
    of different surroundings of one gram are kept. Only the last kept row is carried over to the next batch."""

    def __init__(self):
        self.held: tuple[np.ndarray, bool] | None = None  # the last first occurrence, and whether its gram has another before it
        self.last: tuple[int, int] | None = None

    def __call__(self, batch: pa.RecordBatch):
        rows = np.stack([batch.column(n).to_numpy() for n in ("h", "c", *KEYS, "place")], 1)
        spans = rows[rows[:, 4] < 0]
        rows = rows[rows[:, 4] >= 0]
        out = [self.spans(spans[:, 2], spans[:, 3], -1 - spans[:, 4], spans[:, 1])]
        if len(rows):
            h, c = rows[:, 0], rows[:, 1]
            before = np.array([self.last or (0, 0)], np.int64)
            same = (np.r_[before[0, 0], h[:-1]] == h) & (np.r_[before[0, 1], c[:-1]] == c)
            if self.last is None:
                same[0] = False
            later = rows[same]
            at, left, right = later[:, 4] >> 16, later[:, 4] >> 8 & 255, later[:, 4] & 255
            out.append(self.spans(later[:, 2], later[:, 3], at - left, at + right))
            firsts = rows[~same]
            self.last = (int(h[-1]), int(c[-1]))
            if len(firsts):
                out.append(self.kept(firsts))
        return self.columns(out)

    def kept(self, firsts: np.ndarray) -> np.ndarray:
        """The rows whose gram has another first occurrence; the last is held until the next is known."""
        linked = np.zeros(len(firsts), bool)
        if self.held is not None:
            firsts = np.concatenate([self.held[0], firsts])
            linked = np.r_[self.held[1], linked]
        same = firsts[1:, 0] == firsts[:-1, 0]
        linked[1:] |= same
        linked[:-1] |= same
        self.held = (firsts[-1:], bool(linked[-1]))
        rows = firsts[:-1][linked[:-1]]
        return np.stack([rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4], np.full(len(rows), -1)], 1)

    @staticmethod
    def spans(order, packed, start, end) -> np.ndarray:
        return np.stack([np.zeros(len(order), np.int64), order, packed, start, end], 1)

    @staticmethod
    def columns(parts: list[np.ndarray]):
        rows = np.concatenate(parts)
        return [np.ascontiguousarray(rows[:, i]) for i in range(5)]

    def finish(self):
        if self.held is None or not self.held[1]:
            return None
        row = self.held[0]
        return self.columns([np.stack([row[:, 0], row[:, 2], row[:, 3], row[:, 4], np.full(1, -1)], 1)])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def order_of(strings: Sequence[bytes]) -> list[int]:
    """The rank of each string in sort order."""
    ranks = [0] * len(strings)
    for rank, i in enumerate(sorted(range(len(strings)), key=strings.__getitem__)):
        ranks[i] = rank
    return ranks


def intervals(strings: Sequence[bytes], least: int, order: list[int] | None = None) -> Iterator[tuple[int, list[int]]]:
    """Of the sorted ``strings``: (length of the common prefix, members) of each interval of the common-prefix tree of ``least`` bytes or more.
    ``order`` gives the members in sort order, if not all or if known.

    The sorted order is scanned with a stack of open intervals: a shorter common prefix closes those that are longer. Equal strings
    are in one interval of their whole length; the interval of length 0 is the root.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__) if order is None else order
    stack = [(0, 0)]
    for i in range(1, len(order) + 1):
        shared = common(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        begin = i - 1
        while stack and stack[-1][0] > shared:
            length, begin = stack.pop()
            if length >= least:
                yield length, order[begin:i]
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, begin))


def maximal_repeats(occurrences: Sequence[tuple[bytes, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes after, members) of the maximal repeats of ``length`` bytes or more around one anchor.

    ``occurrences``: the reversed text before the anchor, and the text from it. An interval of the suffixes is a right-maximal
    repeat. Where its occurrences differ to the left, an interval of the texts before them is a repeat that is left-diverse too.
    """
    before = [b for b, _ in occurrences]
    ranks = order_of(before)
    for right, members in intervals([a for _, a in occurrences], length - max(map(len, before), default=0)):
        if len(members) > 1:
            for left, inner in intervals(before, length - right, sorted(members, key=ranks.__getitem__)):
                if len(inner) > 1:
                    yield left, right, inner


class Trees:
    """Reads the occurrences sorted by gram, and gives the spans that repeat an earlier one; a gram's occurrences are at most GROUP rows."""

    def __init__(self):
        self.gram, self.rows = None, []

    def __call__(self, batch: pa.RecordBatch):
        out: list[tuple[int, int, int, int]] = []
        columns = [batch.column(n).to_pylist() for n in ("h", *KEYS, "place", "around")]
        for h, *row in zip(*columns, strict=True):
            if h != self.gram:
                out += self.repeats()
                self.gram, self.rows = h, []
            self.rows.append(row)
        return self.columns(out)

    def repeats(self) -> Iterator[tuple[int, int, int, int]]:
        """Of every repeat, all occurrences but the first. All hold the anchor, so that an occurrence's spans are one."""
        if len(self.rows) < 2:
            return
        rows = sorted(self.rows)
        cut = [(around[: place >> 8 & 255][::-1], around[place >> 8 & 255 :]) for _, _, place, around in rows]
        most_left, most_right = [0] * len(rows), [0] * len(rows)
        for left, right, members in maximal_repeats(cut):
            first = min(members)
            for i in members:
                if i != first:
                    if left > most_left[i]:
                        most_left[i] = left
                    if right > most_right[i]:
                        most_right[i] = right
        for (order, packed, place, _), left, right in zip(rows, most_left, most_right, strict=True):
            if right:
                yield order, packed, (place >> 16) - left, (place >> 16) + right

    @staticmethod
    def columns(out: list[tuple[int, int, int, int]]):
        rows = np.array(out, np.int64).reshape(-1, 4)
        return [np.ascontiguousarray(rows[:, i]) for i in range(4)]

    def finish(self):
        return self.columns(list(self.repeats()))


def _surroundings():
    """The bytes around each of a text's listed anchors."""
    def step(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        listed = batch.column("listed")
        sizes = np.diff(listed.offsets.to_numpy())
        text = np.repeat(np.arange(len(sizes)), sizes)
        flat = listed.flatten()
        h, place = flat.field("h").to_numpy(), flat.field("place").to_numpy()
        p = offsets[text] + (place >> 16)
        raw = data.tobytes()
        around = [raw[a:b] for a, b in zip((p - (place >> 8 & 255)).tolist(), (p + (place & 255)).tolist(), strict=True)]
        return [h, *[batch.column(k).to_numpy()[text] for k in KEYS], place, pa.array(around, pa.binary())]
    return step


def _strings():
    """Every string of LENGTH bytes around an anchor: a 128-bit digest and where it starts."""
    def step(batch: pa.RecordBatch):
        rows: list[tuple[int, int, int, int, int]] = []
        for order, packed, place, around in zip(*[batch.column(n).to_pylist() for n in (*KEYS, "place", "around")], strict=True):
            start = (place >> 16) - (place >> 8 & 255)
            for i in range(len(around) - LENGTH + 1):
                d = hashlib.blake2b(around[i : i + LENGTH], digest_size=16).digest()
                rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), order, packed, start + i))
        flat = np.array(rows, np.int64).reshape(-1, 5)
        return [np.ascontiguousarray(flat[:, i]) for i in range(5)]
    return step


def repeated_spans(rows: DataFrame) -> DataFrame:
    """ord, packed, a, b: spans of bytes of the texts of ``rows`` (ord, packed, text) that repeat an earlier string of LENGTH bytes; they may overlap."""
    found = arrow_pass(rows, ANCHOR_SCHEMA, _find_anchors, PIECE)
    by_gram = spread(found, "h").sortWithinPartitions("h", "c", *KEYS, "place")
    first = stored(arrow_pass(by_gram, "h long, ord long, packed long, a long, b long", Grams), "grams")
    spans = first.where("b >= 0").select(*KEYS, "a", "b")
    open_ = first.where("b < 0").select("h", *KEYS, F.col("a").alias("place"))
    listed = open_.groupBy(*KEYS).agg(F.collect_list(F.struct("h", "place")).alias("listed"))
    around = stored(arrow_pass(rows.join(stored(listed, "listed"), KEYS).select(*KEYS, "text", "listed"), "h long, ord long, packed long, place long, around binary", _surroundings, PIECE), "around")
    large = stored(open_.groupBy("h").count().where(F.col("count") > GROUP).select("h"), "large")
    few, many = around, None
    if not large.isEmpty():
        few, many = around.join(large, "h", "left_anti"), around.join(large, "h")
    by_gram = spread(few, "h").sortWithinPartitions("h")
    spans = spans.unionByName(arrow_pass(by_gram, "ord long, packed long, a long, b long", Trees))
    if many is not None:
        strings = stored(arrow_pass(many.select(*KEYS, "place", "around"), "d1 long, d2 long, ord long, packed long, start long", _strings, PIECE // 8), "strings")
        at = F.struct(*KEYS, "start")
        firsts = stored(strings.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
        again = strings.join(firsts, ["d1", "d2"]).where(at != F.col("first"))
        spans = spans.unionByName(again.select(*KEYS, F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))
    return spans


def _kept():
    def step(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column("text"))
        raw, removed, sha, runs = data.tobytes(), [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            s, e = merged(np.array([x["a"] for x in spans or ()], np.int64), np.array([x["b"] for x in spans or ()], np.int64))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            removed.append(int((e - s).sum()))
            runs.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
            sha.append(digest.hexdigest())
        item = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(item))]
    return step


def without_repeats(docs: DataFrame, key: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id (``key``, an integer), n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run).

    A byte of a text (in UTF-8, null as empty) is removed if a string of LENGTH bytes that covers it also starts earlier: in a row with a smaller key (null keys
    are last; rows that agree in the key are ordered by their place in the files), or earlier in the same text. Strings never cross texts and are
    judged on the input. Texts of fewer than LENGTH bytes stay whole. Very long texts are hashed in segments, and no task holds more than a batch, or the
    at most GROUP surroundings of one gram. Other columns of ``docs`` don't matter; an empty table gives an empty result.
    """
    source = materialized(docs)
    column = F.col(text).cast("string") if isinstance(text, str) else text
    row = keyed(source, doc_id=key, ord=F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), text=F.coalesce(column, F.lit("")))
    packed = (F.shiftleft(F.col(ROW[0]), 32).bitwiseXOR(F.col(ROW[1]))).alias("packed")
    rows = row.select("doc_id", "ord", packed, "text")
    spans = repeated_spans(rows.select(*KEYS, "text")).groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, KEYS, "left").select("doc_id", "text", "spans")
    return arrow_pass(joined, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>", _kept, PIECE)


def brute_force(texts: Sequence[tuple[int, bytes]], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """doc_id -> removed runs, from a table of every string; for tests on small tables."""
    seen: set[bytes] = set()
    out = {}
    for doc, t in sorted(texts):
        a = []
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                a.append(i)
            seen.add(s)
        s, e = merged(np.array(a, np.int64), np.array(a, np.int64) + length)
        out[doc] = list(zip(s.tolist(), e.tolist(), strict=True))
    return out
