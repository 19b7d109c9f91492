"""Periodic runs of words by an online sparse diagonal dynamic programme."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_pass, keyed, mixed, texts
from .words import word_lists, word_names

#: a run has at least so many words, and at least twice its period
LEAST = 12
#: matches in a row that a run of any period has at least: LEAST - q or q of them for a period q
WIDTH = LEAST // 2


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An integer for each pair of integers; equal pairs have equal ones."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def grams_repeat(words: np.ndarray) -> bool:
    """Whether hashes of WIDTH words in a row repeat; if not, no such words do."""
    h = np.zeros(len(words) - WIDTH + 1, np.uint64)
    spread = mixed(words.astype(np.uint64) + np.uint64(1))
    for k in range(WIDTH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + spread[k : k + len(h)]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def gram_names(words: np.ndarray) -> np.ndarray:
    """Names of WIDTH = 6 words in a row."""
    two = pair_names(words[:-1], words[1:])
    four = pair_names(two[:-2], two[2:])
    return pair_names(four[:-2], two[4:])


def previous(names: np.ndarray) -> np.ndarray:
    """The last earlier position of the same name, -1 if there is none."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    same = s[1:] == s[:-1]
    before = np.full(len(names), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    return before


def diagonals(before: np.ndarray, width: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """lag, first, last: maximal stretches of positions whose gram of ``width`` words is the one ``lag`` earlier, for low <= lag < high.

    Goes over the positions once. Each earlier occurrence continues the stretch of its lag or opens one; a lag that a position does not
    continue has ended and is given out. Occurrences in steps of p <= width are one run of period p: of them only the nearest is followed, since
    a lag of several p has p as the smaller period there.
    """
    at = np.flatnonzero((before >= 0) & (np.arange(len(before)) - before < high)).tolist()
    earlier = before.tolist()
    active: dict[int, int] = {}
    root: dict[int, int] = {}
    last = -1
    for i in at:
        if i != last + 1:
            for lag, first in active.items():
                yield lag, first, last
            active = {}
        j = earlier[i]
        p = i - j
        root[i] = end = root[j] if p <= width and j in root and j - earlier[j] == p else j
        now = {}
        if p >= low:
            now[p] = active.pop(p, i)
        j = earlier[end]
        while j >= 0 and i - j < high:
            if i - j >= low:
                now[i - j] = active.pop(i - j, i)
            j = earlier[j]
        for lag, first in active.items():
            yield lag, first, last
        active, last = now, i
    for lag, first in active.items():
        yield lag, first, last


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run, by start and period.

    A run of period q has max(LEAST - q, q) or more matches in a row at the lag q. So grams of WIDTH words find lags below 2 * WIDTH, and grams twice as
    wide those up to twice as far, as long as any gram repeats: most texts end with the first.
    """
    found: dict[tuple[int, int], int] = {}
    if len(words) < LEAST or not grams_repeat(words):
        return []
    names, width, low = gram_names(words), WIDTH, 1
    while 2 * low <= len(words):
        before = previous(names)
        if (before < 0).all():
            break
        for lag, first, last in diagonals(before, width, low, 2 * width):
            matches = last - first + width
            if matches >= max(LEAST - lag, lag):
                place = (first - lag, matches + lag)
                found[place] = min(lag, found.get(place, lag))
        names, low, width = pair_names(names[:-width], names[width:]), 2 * width, 2 * width
    return sorted((start, length, period) for (start, length), period in found.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return keep


def collapsed(data: bytes, keep: np.ndarray | None) -> bytes:
    """The kept words of a text (None: all) joined by single spaces."""
    parts, at = [], 0
    for words in word_lists(data):
        if keep is not None:
            words, at = [w for w, k in zip(words, keep[at : at + len(words)].tolist(), strict=True) if k], at + len(words)
        if words:
            parts.append(b" ".join(words))
    return b" ".join(parts)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id (``key``), n_words, runs (array of start, length, period), collapsed (text).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q (words q apart are identical), of at least
    LEAST words and 2 * q, that no neighbouring word extends; ``runs`` has them by start, then period. ``collapsed`` holds the words that no run
    has after its first q words, joined by one space. A null or empty text has no words, no runs and an empty ``collapsed``. Rows that repeat are
    judged each; other columns, whatever their names, are left out; an empty table gives no rows. Each text is read whole, in one task, without a
    shuffle; memory is some 50 bytes a word. Time follows the words and the matches at active lags; it is worst, words times the length of a block, where
    blocks of one repeated word alternate with others.
    """
    kind = docs.schema[key].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def start():
        def step(batch: pa.RecordBatch):
            n, starts, flat, text_out = [], [0], [], []
            for t in texts(batch, "text"):
                data = t.encode()
                words = word_names(data)
                found = runs(words)
                n.append(len(words))
                flat += found
                starts.append(len(flat))
                text_out.append(collapsed(data, kept_words(len(words), found) if found else None))
            columns = np.array(flat, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], fields=list(run))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs)
            return [*[batch.column(c) for c in (*ROW, "doc_id")], pa.array(n, pa.int64()), lists, pa.array(text_out, pa.binary()).cast(pa.string())]
        return step

    rows = keyed(docs, doc_id=key, text=F.col(text).cast("string") if isinstance(text, str) else text)
    return arrow_pass(rows, f"{ROW[0]} long, {ROW[1]} long, doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", start)


def longest(found: str = "runs") -> Column:
    """The run of greatest length; of those the one with the smallest start, then period. Null if there is none."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["small"]).alias("period")))


def brute_force(words: list) -> list[tuple[int, int, int]]:
    """All runs by comparing every lag word by word; for tests."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(LEAST, 2 * q):
                found.setdefault((first - q, i - first + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())
