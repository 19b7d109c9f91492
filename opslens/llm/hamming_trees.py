"""Pairs of 64-bit fingerprints that differ in few bits, by vantage-point trees over Hamming distance."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, plain

#: fingerprints from which the upper part of the trees is built: at most so many, and at most one of SAMPLE_SHARE
SAMPLE, SAMPLE_SHARE = 1 << 18, 4
#: about so many fingerprints are a shard, but not fewer than LEAST_SAMPLED of the sample
SHARD, LEAST_SAMPLED = 4096, 32
#: points of a branch that are compared directly, vantage points that are tried for a branch
LEAF, TRIED = 256, 6


def halves(x: np.ndarray, side: int) -> np.ndarray:
    """The upper (0) or lower (1) 32 bits."""
    return ((x >> np.uint64(32)) if side == 0 else x).astype(np.uint32)


def vantage(x: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point and the distance up to which points are near it, so that few pairs remain to compare; None if no point divides ``x``.

    Points beyond the distance, and near ones that may be within ``radius`` of such a point, make the other branch. Of a few points
    of ``x`` and all distances the pair is taken that leaves least work.
    """
    best, width = None, 8 * x.dtype.itemsize
    for v in x[np.linspace(0, len(x) - 1, TRIED).astype(int)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(x ^ v), minlength=width + 1))
        far = len(x) - np.r_[np.zeros(radius, np.int64), upto[: width + 1 - radius]]
        work = upto.astype(float) ** 2 + far.astype(float) ** 2
        mid = int(np.argmin(work[:-1]))
        if best is None or work[mid] < best[0]:
            best = (work[mid], int(v), mid)
    return best[1:] if best[0] < 0.9 * float(len(x)) ** 2 else None


def branches(x: np.ndarray, at: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points are near the vantage point, and which are far or so close to the boundary that a far one may be within ``radius``."""
    d = np.bitwise_count(x ^ x.dtype.type(at[0]))
    return d <= at[1], d > at[1] - radius


def build(sample: np.ndarray, radius: int, most: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, distance, near child, far child) of a tree over ``sample``; -1 - k as a child is leaf k, and the root is node 0.

    Branches of at most ``most`` points are leaves. A tree without a node has the one leaf 0.
    """
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        at = vantage(x, radius) if len(x) > most else None
        if at is None:
            leaves += 1
            return -leaves
        here = len(nodes)
        nodes.append((*at, 0, 0))
        near, far = branches(x, at, radius)
        nodes[here] = (*at, grow(x[near]), grow(x[far]))
        return here

    grow(sample)
    return nodes


def leaves_of(x: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of the points of ``x`` that belong to it or to its boundary)."""
    todo = [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -1 - node, rows
            continue
        v, mid, left, right = nodes[node]
        near, far = branches(x[rows], (v, mid), radius)
        todo += [(left, rows[near]), (right, rows[far])]


def close_pairs(x: np.ndarray, side: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs of ``x`` that differ in at most ``most`` bits and in at most most // 2 of the half ``side``; pairs may repeat.

    A tree over distances of the half prunes; where these don't divide a branch, distances of all 64 bits do; what neither divides is compared in blocks.
    """
    part, radius = halves(x, side), most // 2
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        at = whole = None
        if len(rows) > LEAF:
            at = vantage(part[rows], radius)
            whole = vantage(x[rows], most) if at is None else None
        if at is not None or whole is not None:
            near, far = branches(part[rows], at, radius) if at is not None else branches(x[rows], whole, most)
            todo += [rows[near], rows[far]]
            continue
        for a in range(0, len(rows), LEAF):
            for b in range(a, len(rows), 1 << 14):
                one, other = rows[a : a + LEAF], rows[b : b + (1 << 14)]
                i, j = np.nonzero(np.bitwise_count(x[one][:, None] ^ x[other]) <= most)
                ok = one[i] < other[j]
                if ok.any():
                    yield one[i[ok]], other[j[ok]]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Pairs that connect what all ``pairs`` connect, fewer than ``n``."""
    head, kept = np.arange(n), []
    for i, j in pairs:
        open_ = head[i] != head[j]
        for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            x, y = a, b
            while head[x] != x:
                x = int(head[x])
            while head[y] != y:
                y = int(head[y])
            if x != y:
                head[max(x, y)] = min(x, y)
                kept.append((a, b))
        while (head[head] != head).any():
            head = head[head]
    return kept


def hamming_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """a, b: pairs of ``prints`` (fp: long, distinct) that differ in at most ``most`` bits and connect all that such pairs connect.

    Two fingerprints that differ in at most ``most`` bits differ in at most most // 2 of one half. So there is a tree for either half. Its upper part
    is built on the driver from a sample (a hash picks at most SAMPLE fingerprints, and at most about one of SAMPLE_SHARE) and deals all fingerprints to shards: each to the leaf it
    falls into and to the leaves whose boundary lies within most // 2 of it, so that each pair meets in a shard. A shard grows the tree further over its own points
    and returns only links that connect something new, fewer than it has points. Results are exact and don't depend on the sample.
    No rows: no links.
    """
    radius, total = most // 2, prints.count()
    share = max(SAMPLE_SHARE, -(-total // SAMPLE))
    picked = prints.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(share)) == 0).toArrow()
    sample = np.sort(plain(picked.column("fp").combine_chunks()).astype(np.int64)).view(np.uint64)
    trees = [build(halves(sample, side), radius, max(LEAST_SAMPLED, SHARD // share)) for side in (0, 1)]

    def deal():
        def step(batch: pa.RecordBatch):
            fp = plain(batch.column("fp"))
            x = fp.view(np.uint64)
            shard, rows = [], []
            for side, tree in enumerate(trees):
                for leaf, at in leaves_of(halves(x, side), tree, radius):
                    shard.append(np.full(len(at), 2 * leaf + side, np.int64))
                    rows.append(at)
            return [np.concatenate(shard), fp[np.concatenate(rows)]] if shard else None
        return step

    def search(shard: pa.Table) -> pa.Table:
        fp = np.sort(plain(shard.column("fp").combine_chunks()))
        kept = np.array(forest(len(fp), close_pairs(fp.view(np.uint64), int(shard.column("shard")[0].as_py()) % 2, most)), np.int64).reshape(-1, 2)
        return pa.table({"a": fp[kept[:, 0]], "b": fp[kept[:, 1]]})

    return arrow_pass(prints.select("fp"), "shard long, fp long", deal).groupBy("shard").applyInArrow(search, "a long, b long")
