"""Near duplicates by Order MinHash sketches, verified by banded alignment."""
from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_pass, keyed, materialized, mixed, only_rows, stored, texts
from .components import components

WORD = re.compile(r"[^\W_]+")
#: words of a shingle, least similarity
WORDS, SHARE = 5, 0.8
#: shingles of a sketch value, values of a sketch: of all texts, then of those in groups too large to compare. Either way two texts at the least
#: similarity share no value in 1 of 5,000 cases (0.3 for three shingles, 0.09 for six)
TIERS = ((3, 24), (6, 96))
#: the smallest shingle hashes kept to estimate overlap, and how far below the least overlap (2/3 for SHARE) an estimate is still aligned:
#: 5 standard deviations of an estimate from 256 hashes (1 in 3 million); of texts with fewer shingles the overlap is known exactly
BOTTOM, DOUBT = 256, 0.1475
#: groups of candidates up to this size are compared in full at once, larger ones with two of their members first
SMALL = 8
#: members, and shingles of all of them, up to which a group is compared within one task
BLOCK, WEIGHT = 2048, 8_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def seeds(tier: int) -> np.ndarray:
    """An odd multiplier for each value of a sketch."""
    first = 1 + 1000 * tier
    return mixed(np.arange(first, first + TIERS[tier][1], dtype=np.uint64) * _GOLDEN) | np.uint64(1)


class Words(dict):
    """Word -> 64-bit hash, remembered in bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str, words: Words) -> np.ndarray:
    found = WORD.findall(text.lower())
    return np.fromiter(map(words.__getitem__, found), np.uint64, len(found))


def shingle_hashes(w: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash of each n adjacent words; of all words if there are fewer."""
    n = min(n, len(w))
    if not n:
        return w
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * _GOLDEN + np.uint64(i + 1)
    return mixed(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that tell the occurrences of an equal shingle apart: the first (which keeps its hash), the second and so on."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return h
    at = np.arange(len(h))
    out = np.empty_like(h)
    again = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    out[order] = np.where(first, s, mixed(s + again * _GOLDEN))
    return out


def sketch(h: np.ndarray, label: np.ndarray, tier: int, by: np.ndarray) -> np.ndarray:
    """One value for each of the ``seeds`` ``by``: the labelled shingles with the smallest hashes, hashed together in text order."""
    n, picked = len(label), TIERS[tier][0]
    k = min(picked, n)
    best = np.empty((len(by), 0), np.int64)
    for a in range(0, n, 4096):  # long texts in pieces
        at = np.concatenate([best, np.broadcast_to(np.arange(a, min(n, a + 4096)), (len(by), min(n, a + 4096) - a))], 1)
        v = label[at] * by[:, None]
        v ^= v >> np.uint64(31)
        v *= _GOLDEN
        best = np.take_along_axis(at, np.argpartition(v, min(k, v.shape[1]) - 1, axis=1)[:, :k], 1)
    best.sort(1)
    value = np.zeros(len(by), np.uint64)
    for i in range(k):
        value = mixed(value * np.uint64(31) + h[best[:, i]])
    return value


def as_lists(values: list[np.ndarray], width: int) -> pa.ListArray:
    flat = pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)


def sketches(rows: DataFrame) -> DataFrame:
    """ROW, doc_id, fp_a, fp_b (identity of the words in order), n (shingles), bands, bottom; texts without a word are left out."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def start():
        words, by = Words(), seeds(0)

        def step(batch: pa.RecordBatch):
            keep, fp, n, bands, bottom = [], [], [], [], []
            for i, text in enumerate(texts(batch, "text")):
                w = word_hashes(text, words)
                if not len(w):
                    continue
                h = shingle_hashes(w)
                label = labelled(h)
                keep.append(i)
                raw = w.tobytes()
                fp.append((xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw, 9)))
                n.append(len(h))
                bands.append(sketch(h, label, 0, by))
                low = np.sort(label if len(label) <= BOTTOM else np.partition(label, BOTTOM)[:BOTTOM])
                bottom.append((low >> np.uint64(32)).astype(np.uint32).tobytes())
            ids = np.array(keep, np.int64)
            fp = np.array(fp, np.uint64).reshape(-1, 2).view(np.int64)
            return [*[batch.column(c).take(pa.array(ids)) for c in (*ROW, "doc_id")], pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(n, pa.int32()), as_lists(bands, len(by)),
                    pa.array(bottom, pa.binary())]
        return step

    return arrow_pass(rows, f"{ROW[0]} long, {ROW[1]} long, doc_id {kind}, fp_a long, fp_b long, n int, bands array<long>, bottom binary", start)


def further_sketches(docs: DataFrame, nodes: DataFrame, tier: int) -> DataFrame:
    """``nodes`` (ROW, node, n, bottom) with the sketch values of a further tier as bands."""
    rows = docs.join(nodes, ROW).select("node", "n", "bottom", "text")

    def start():
        words, by = Words(), seeds(tier)

        def step(batch: pa.RecordBatch):
            values = []
            for text in texts(batch, "text"):
                h = shingle_hashes(word_hashes(text, words))
                values.append(sketch(h, labelled(h), tier, by))
            return [*[batch.column(c) for c in ("node", "n", "bottom")], as_lists(values, len(by))]
        return step

    return stored(arrow_pass(rows, "node long, n int, bottom binary, bands array<long>", start), "further")


def may_be_similar(a: bytes, b: bytes, share: float) -> bool:
    """Whether the overlap of two texts' smallest hashes leaves it open that ``share`` of the longer one's shingles match.

    Such a match means an overlap of share / (2 - share) or more, whatever the lengths.
    """
    exact = max(len(a), len(b)) < 4 * BOTTOM
    return overlap(a, b) >= share / (2 - share) - (1e-9 if exact else DOUBT)


def overlap(a: bytes, b: bytes) -> float:
    """Share of the labelled shingles that two texts have in common, estimated from their smallest hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    # of the union's smallest values, as many as are known of both
    upto = BOTTOM if len(x) == BOTTOM or len(y) == BOTTOM else len(both)
    once = np.flatnonzero(np.r_[True, ~twice])[:upto]
    return int(twice[: once[-1] + 1].sum()) / len(once) if len(once) else 0.0


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two hash sequences whose matches lie within ``band`` of the diagonal.

    Bit-parallel: bit i of the state stands for element i of ``a``; the elements of ``b`` are the steps.
    """
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    n = len(a)
    state = full = (1 << n) - 1
    window = (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        at = where.get(x)
        if at is not None:
            low = j - band
            hit = state & at & (window << low if low >= 0 else window >> -low)
            if hit:
                state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def similar(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    """Whether an alignment of the shingles matches at least ``share`` of the longer text's."""
    need = int(np.ceil(round(share * max(len(a), len(b)), 6)))
    if min(len(a), len(b)) < need:
        return False
    band = len(a) + len(b) - 2 * need
    m = min(len(a), len(b))
    ahead = int(np.argmin(np.r_[a[:m] == b[:m], False]))
    m -= ahead
    behind = int(np.argmin(np.r_[a[len(a) - m :][::-1] == b[len(b) - m :][::-1], False])) if m else 0
    a, b = a[ahead : len(a) - behind], b[ahead : len(b) - behind]
    # an alignment matches no more than the shingles that both hold, which are counted faster
    if ahead + behind + len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return False
    return ahead + behind + (aligned(a, b, band) if len(a) and len(b) else 0) >= need


def _near(x: str, y: str, share: float) -> Column:
    """Whether the lengths ``x`` and ``y`` can be those of similar texts."""
    return F.least(x, y) >= F.lit(share) * F.greatest(x, y) - 1e-6


def _pairs(groups: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """First candidate pairs (a < b) of ``groups`` (key, node, band, n), and the groups that are too large to compare in full at once.

    A large group's members are paired with two of them: the one whose groups are largest in all, which is the original where the others are
    copies of it, and one picked by a hash of key and node. Nodes whose lengths can't be similar are not paired.
    """
    sizes = stored(groups.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = stored(groups.join(sizes, "key"), "members")
    few = members.where(F.col("size") <= SMALL)
    one, other = (few.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    full = one.join(other, "key").where((F.col("a") < F.col("b")) & _near("n_a", "n_b", share)).select("a", "b")
    many = members.where(F.col("size") > SMALL)
    central = stored(many.groupBy("node").agg(F.sum("size").alias("reach")), "central")
    hub, some = F.max(F.struct("reach", "h", "node", "n")), F.min(F.struct("h", "node", "n"))
    picked = many.join(central, "node").withColumn("h", F.xxhash64("key", "node")).groupBy("key").agg(hub.alias("hub"), some.alias("some"))
    heads = picked.select("key", F.array_distinct(F.array(*[F.struct(F.col(f"{x}.node").alias("node"), F.col(f"{x}.n").alias("n")) for x in ("hub", "some")])).alias("heads"))
    star = many.join(stored(heads, "heads"), "key").select("node", "n", F.explode("heads").alias("head")).where((F.col("node") != F.col("head.node")) & _near("n", "head.n", share))
    star = star.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
    return full.unionByName(star).distinct(), many.select("key", "node", "band", "n")


def _unlinked(many: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, band, n, label, k of the large groups that are not one component yet; k blocks of a group can be compared within a task each."""
    marked = many.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / WEIGHT)).cast("int")
    open_keys = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.alias("k")).where("lo < hi").select("key", "k")
    return stored(marked.join(stored(open_keys, "open"), "key").select("key", "node", "band", "n", "label", "k"), "rest")


def common_counts(bottoms: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their smallest hashes each of the texts ``a`` has in common with each of ``b`` (positions in ``bottoms``)."""
    lengths = np.array([len(x) // 4 for x in bottoms])
    _, column, often = np.unique(np.frombuffer(b"".join(bottoms), np.uint32), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(bottoms)), lengths)
    shared = often > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    counts, width = np.zeros((len(a), len(b)), np.float32), 4096
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        there = np.zeros((len(bottoms), width), np.float32)
        there[row[lo:hi], column[lo:hi] - start] = 1
        counts += there[a] @ there[b].T
    return counts


def open_pairs(unit: pa.Table, share: float) -> pa.Table:
    """unit, node, label, partners of the members of a group (side 2), or of two blocks of one (side 0 and 1), that may be similar to one of another label.

    Partners are nodes, the likeliest first; each pair is with one of the two. Pairs that agree in a lower band are left to the group they have there.
    """
    col = {c: unit.column(c).to_numpy() for c in ("node", "n", "label", "side", "band")}
    node, n, label, side = col["node"], col["n"], col["label"], col["side"]
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    none = pa.table({"unit": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "partners": pa.array([], pa.list_(pa.int64()))})
    if not len(a) or not len(b) or (label == label[0]).all():
        return none
    bands = np.array(unit.column("bands").to_pylist(), np.int64)[:, : col["band"][0]]
    ok = label[a][:, None] != label[b]
    if side[0] == 2:
        ok &= node[a][:, None] < node[b]
    ok &= np.minimum(n[a][:, None], n[b]) >= share * np.maximum(n[a][:, None], n[b]) - 1e-6
    for q in range(bands.shape[1]):
        ok &= bands[a, q][:, None] != bands[b, q]
    at, bt = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if not len(at):
        return none
    a, b, ok = a[at], b[bt], ok[np.ix_(at, bt)]
    bottoms = unit.column("bottom").to_pylist()
    known = np.array([len(x) // 4 for x in bottoms])
    common = common_counts(bottoms, a, b)
    x, y = known[a][:, None], known[b]
    full = np.maximum(x, y) >= BOTTOM
    # never less than the estimate of ``overlap``, which counts those among the smallest of the union
    common /= np.where(full, np.minimum(BOTTOM, x + y - common), x + y - common)
    ok &= common >= share / (2 - share) - np.where(full, DOUBT, 1e-6)
    i, j = np.nonzero(ok)
    if not len(i):
        return none
    order = np.lexsort((-common[i, j], i))
    i, j = i[order], j[order]
    members = np.unique(np.r_[a[i], b[j]])
    counts = np.bincount(np.searchsorted(members, a[i]), minlength=len(members))
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    partners = pa.ListArray.from_arrays(offsets, pa.array(node[b[j]]))
    return pa.table({"unit": unit.column("unit").take(pa.array(members)), "node": node[members], "label": label[members], "partners": partners})


def confirmed_links(unit: pa.Table, share: float) -> pa.Table:
    """a, b: of the pairs that ``open_pairs`` gives for a unit, those that an alignment of their seq confirms and that connect two components; fewer than members."""
    node, label, counts = unit.column("node").to_numpy(), unit.column("label").to_numpy(), pa.compute.list_value_length(unit.column("partners")).to_numpy()
    seqs = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit.column("seq")]
    kinds: list[np.ndarray | None] = [None] * len(seqs)
    order = np.argsort(node)
    one = np.repeat(np.arange(len(node)), counts)
    other = order[np.searchsorted(node, pa.compute.list_flatten(unit.column("partners")).to_numpy(), sorter=order)]
    turn = np.argsort(np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts, counts), kind="stable")  # everybody's likeliest first
    head = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    def kind(i: int) -> np.ndarray:
        if kinds[i] is None:
            kinds[i] = np.sort(labelled(seqs[i]))
        return kinds[i]

    links = []
    for i, j in zip(one[turn].tolist(), other[turn].tolist(), strict=True):
        x, y = find(int(label[i])), find(int(label[j]))
        if x == y:
            continue
        # an alignment matches no more than the shingles that both hold
        both = np.sort(np.concatenate([kind(i), kind(j)]))
        if np.count_nonzero(both[1:] == both[:-1]) >= share * max(len(seqs[i]), len(seqs[j])) - 1e-6 and similar(seqs[i], seqs[j], share):
            head[max(x, y)] = min(x, y)
            links.append((node[i], node[j]))
    found = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _compared(rest: DataFrame, nodes: DataFrame, share: float, sequences) -> DataFrame:
    """Links of members of the groups ``rest`` (see ``_unlinked``) that connect their components.

    A group is one piece; one of several blocks is a piece for each two of them. A first pass over a piece's smallest hashes tells which members need their
    ``sequences`` (a function of nodes); a second one aligns them. No row is made of a pair, only of members and of links.
    """
    r, k = F.col("r"), F.col("k")
    unit = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(
        F.when(k == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(r, o), F.greatest(r, o))).alias("unit"), F.when(o == r, 2).when(r < o, 0).otherwise(1).alias("side")))
    dealt = rest.withColumn("r", F.pmod(F.xxhash64("node"), k).cast("int")).select("node", "band", "n", "label", F.explode(unit).alias("at"))
    dealt = dealt.select("node", "band", "n", "label", "at.unit", "at.side").join(nodes.select("node", "bands", "bottom"), "node")
    left = stored(dealt.groupBy("unit").applyInArrow(lambda t: open_pairs(t, share), "unit long, node long, label long, partners array<long>"), "left")
    whole = left.join(sequences(left.select("node").distinct()), "node")
    return stored(whole.groupBy("unit").applyInArrow(lambda t: confirmed_links(t, share), "a long, b long"), "confirmed")


def _links(pairs: DataFrame, nodes: DataFrame, sequences: DataFrame, share: float) -> DataFrame:
    """The ``pairs`` that an alignment confirms, after their estimated overlap."""
    def side(df: DataFrame, n: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns])

    close = pairs.join(side(nodes, "a", "bottom"), "a").join(side(nodes, "b", "bottom"), "b")

    def estimate():
        def step(batch: pa.RecordBatch):
            ok = [may_be_similar(x, y, share) for x, y in zip(batch.column("bottom_a").to_pylist(), batch.column("bottom_b").to_pylist(), strict=True)]
            kept = pa.array(ok, pa.bool_())
            return [batch.column(c).filter(kept) for c in ("a", "b")]
        return step

    close = stored(arrow_pass(close, "a long, b long", estimate), "close")
    both = close.join(side(sequences, "a", "seq"), "a").join(side(sequences, "b", "seq"), "b")

    def align():
        def step(batch: pa.RecordBatch):
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share) for x, y in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist(), strict=True)]
            kept = pa.array(ok, pa.bool_())
            return [batch.column(c).filter(kept) for c in ("a", "b")]
        return step

    return stored(arrow_pass(both, "a long, b long", align), "aligned")


def _sequences(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, seq (its shingle hashes in text order) of ``nodes``."""
    rows = docs.join(nodes.select(*ROW, "node"), ROW).select("node", "text")

    def start():
        words = Words()

        def step(batch: pa.RecordBatch):
            return [batch.column("node"), pa.array([shingle_hashes(word_hashes(t, words)).tobytes() for t in texts(batch, "text")], pa.binary())]
        return step

    return stored(arrow_pass(rows, "node long, seq binary", start), "sequences")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``labels`` (see ``components``) after further ``links``, which are few: they are carried over to components before these are joined."""
    if labels is None:
        return stored(components(links), "labels")
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    more = stored(components(between.where("a <> b")), "more")
    moved = more.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(more), "labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: Column | str = "text", share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: ROW, doc_id (``key``), class_id, class_size, kept.

    Two texts are near duplicates if an alignment of their five-word shingles matches at least ``share`` of the longer one's; a class is a set that
    such links connect. Words are runs of letters and digits in lower case; a text of fewer words is one shingle. class_id is the smallest key of the class
    and that row stays (null keys are last; of rows that agree in the key the first in its file). Texts with the same words are one node with one set of
    sketches. A null or empty text, or one without a word, is a class of its own. Other columns of ``docs`` don't matter.

    Candidates share a sketch value of the first of TIERS. At the least similarity (equal lengths) a value agrees with probability 0.3, so that a pair is
    overlooked in 1 of 5,000 cases, and above it in far fewer. Groups of candidates are compared in full, whatever their size: up to SMALL members
    at once; a larger one first with two of its members, then, if that leaves it in several components, every pair of members that are still in
    different ones, within one task, which returns links only. A group that is too large for a task (BLOCK, WEIGHT) and still in several components is dealt anew by
    the values of the next tier, of more shingles and so in smaller groups; one that is too large even by the last tier's is compared in blocks, two by two.
    """
    source = materialized(docs)
    whole = keyed(source, doc_id=key, text=F.col(text).cast("string") if isinstance(text, str) else text)
    found = stored(sketches(whole), "sketches")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)
    same = found.groupBy("fp_a", "fp_b").agg(F.min(first).alias("first"), F.min_by("n", first).alias("n"), F.min_by("bands", first).alias("bands"), F.min_by("bottom", first).alias("bottom"))
    nodes = stored(same.select(F.monotonically_increasing_id().alias("node"), "fp_a", "fp_b", *[F.col(f"first.{c}").alias(c) for c in ROW], "n", "bands", "bottom"), "nodes")
    known = []

    def sequences(wanted: DataFrame) -> DataFrame:
        """node, seq of the nodes ``wanted``; what was made before is not made again."""
        new = wanted
        for df in known:
            new = new.join(df.select("node"), "node", "left_anti")
        known.append(_sequences(whole, nodes.join(stored(new, "wanted"), "node")))
        return functools.reduce(DataFrame.unionByName, known)

    labels, level = None, nodes.select("node", "n", "bands", "bottom")
    for tier in range(len(TIERS)):
        groups = level.select("node", "n", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node", "band", "n")
        pairs, many = _pairs(groups, share)
        pairs = stored(pairs, "pairs")
        involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        labels = _merged(labels, _links(pairs, level.select("node", "bottom"), sequences(involved), share))
        rest = _unlinked(many, labels)
        if rest.isEmpty():
            break
        last = tier == len(TIERS) - 1
        labels = _merged(labels, _compared(rest if last else rest.where("k = 1"), level, share, sequences))
        large = None if last else stored(_unlinked(many.join(rest.where("k > 1").select("key").distinct(), "key"), labels).select("node").distinct(), "large")
        if last or large.isEmpty():
            break
        level = further_sketches(whole, nodes.select(*ROW, "node", "n", "bottom").join(large, "node"), tier + 1)
    classed = nodes.join(labels, "node", "left").select("fp_a", "fp_b", F.coalesce("label", "node").alias("class"))
    members = stored(found.select(*ROW, "doc_id", "fp_a", "fp_b").join(stored(classed, "classed"), ["fp_a", "fp_b"]).select(*ROW, "doc_id", "class"), "members")
    heads = stored(members.groupBy("class").agg(F.min(first).alias("head"), F.count("*").alias("class_size")), "heads")
    judged = members.join(heads, "class").select(*ROW, F.col("head.doc_id").alias("class_id"), "class_size",
                                                 ((F.col(ROW[0]) == F.col(f"head.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"head.{ROW[1]}"))).alias("kept"))
    every = keyed(source, doc_id=key)
    return every.join(stored(judged, "judged"), ROW, "left").select(
        *ROW, "doc_id", F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("kept", F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class (see ``near_duplicates``)."""
    docs = materialized(docs)
    return only_rows(docs, near_duplicates(docs, **options).where("not kept"), "left_anti")


def brute_force(rows: Sequence[tuple[int, str]], share: float = SHARE) -> dict[int, int]:
    """doc_id -> class_id by comparing every pair; for tests on small tables."""
    words = Words()
    seqs = {d: shingle_hashes(word_hashes(t or "", words)) for d, t in rows}
    head = {d: d for d in seqs}

    def find(x: int) -> int:
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(seqs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(seqs[a]) and len(seqs[b]) and find(a) != find(b) and similar(seqs[a], seqs[b], share):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {d: find(d) for d in ids}
