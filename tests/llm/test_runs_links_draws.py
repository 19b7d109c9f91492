"""Periodic runs, SimHash components and importance resampling against brute force."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opslens.llm import hamming_trees, periodic_runs, queries, resampling, simhash, words

from odd import given, no_docs, odd_docs, odd_rows  # noqa: F401, I001

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# periodic runs

@settings(max_examples=400, deadline=None)
@cases(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 20), st.integers(1, 6), st.integers(0, 19))
def test_runs_equal_brute_force(w, period, times, cut):
    for text in (w, (w[:period] * times)[: max(0, len(w[:period]) * times - cut)] + w, w + w[:period] * times + w):
        assert periodic_runs.runs(np.array(text, np.int64)) == periodic_runs.brute_force(text)


def test_runs_of_nested_and_long_periods():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1000:
        fib.append(fib[-1] + fib[-2])
    block = [0] * 40
    for w in (fib[-1], [0] * 500, [0, 0, 1] * 200, (block + [1] + block + [2]) * 7, (fib[8] + [2]) * 6, list(range(300)) * 3 + list(range(299)) * 2):
        assert periodic_runs.runs(np.array(w, np.int64)) == periodic_runs.brute_force(w)


def planted_words(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def expected_runs(doc_id, text):
    w = planted_words(doc_id, WORD.findall(text or ""))
    found = periodic_runs.brute_force(w)
    best = min(((-length, s, q) for s, length, q in found), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    left = " ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def run_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=repr)


def test_registered_runs_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(x.text or "") < 9000]
    rows += [(None, "a b " * 20), (9001, None), (9002, ""), (9003, " \t "), (9004, "x\x0by\x1cz " * 9), (9005, "é" + " é" * 30), (9005, "é" + " é" * 30)]
    rows += [(9100 + i, " ".join(r.choice("ab") for _ in range(r.randint(1, 60)))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = run_rows(queries.op13_periodic_runs(spark, str(tmp_path)))
    assert got == sorted((expected_runs(*x) for x in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 30 and any(x[1] == 0 for x in got)


def test_runs_of_odd_rows(odd_docs, no_docs):
    got = periodic_runs.periodic_runs(odd_docs).collect()
    assert Counter((x.doc_id, x.n_words, tuple(map(tuple, x.runs))) for x in got) == Counter(
        (d, len(w), tuple(periodic_runs.runs(words.word_names((t or "").encode())))) for d, t, *_ in odd_rows() for w in [WORD.findall(t or "")])
    assert {x.collapsed for x in got if x.doc_id in (3, 4)} == {""}
    assert periodic_runs.periodic_runs(no_docs).count() == 0


def test_pieces_end_at_white_space():
    data = b"one two\tthree  four\nfive " * 3 + b"x" * 30
    for most in (1, 4, 9, 1000):
        assert [w for c in words.chunks(data, most) for w in c.split()] == data.split()


# SimHash

def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    values = sorted({f for _, f in prints})
    group = {f: f for f in values}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            group[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in prints), key=repr)


def test_registered_components_equal_brute_force(spark, given, tmp_path):
    r = random.Random(8)
    base = WORD.findall(given[5][1])
    rows = list(given)
    for i in range(200):  # a chain of edits
        base = list(base)
        base[r.randrange(len(base))] = f"w{i}"
        rows.append((5000 - i, " ".join(base)))
    rows += [(6000, None), (6001, ""), (6002, " \n"), (None, "A b"), (6003, "a B"), (None, "nobody else"), (6004, "one"), (6004, "one"), (6005, "É é Ab\x0bc")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(x[c] for c in ("doc_id", "fingerprint", "component_id")) for x in queries.op11_simhash_dedup(spark, str(tmp_path)).collect()), key=repr)
    want = plain_components(rows)
    assert got == want
    assert 100 < len({x[2] for x in want}) < len(rows) - 100


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "The quick brown fox " * 40 + "jumps"
    monkeypatch.setattr(words, "PIECE", 7)
    monkeypatch.setattr(words.chunks, "__defaults__", (7,))
    assert f"{simhash.fingerprint(text.encode()) % 2**64:016x}" == f"{plain_fingerprint(text):016x}"
    assert len(set(words.word_names(text.encode()).tolist())) == 5


@pytest.fixture(scope="module")
def crowd():
    """Fingerprints at random, chains, a dense ball, and many that agree in one half."""
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(3000)}
    for _ in range(300):
        f = r.choice(sorted(values)[:50])
        for _ in range(6):
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
            values.add(f)
    centre, half = r.getrandbits(64), r.getrandbits(32)
    values |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(2500)}
    values |= {half << 32 | r.getrandbits(32) for _ in range(1500)}
    return np.array(sorted(values), np.uint64)


def all_pairs(x, most):
    found = set()
    for a in range(0, len(x), 500):
        i, j = np.nonzero(np.bitwise_count(x[a : a + 500, None] ^ x) <= most)
        found |= {(u, v) for u, v in zip((i + a).tolist(), j.tolist(), strict=True) if u < v}
    return found


def component_count(n, pairs):
    return n - len(hamming_trees.forest(n, iter([(np.array([a]), np.array([b])) for a, b in pairs])))


def test_trees_find_every_close_pair(crowd):
    found = set()
    for side in (0, 1):
        for i, j in hamming_trees.close_pairs(crowd, side, 3):
            found |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    want = all_pairs(crowd, 3)
    assert found == want and len(want) > 3000


def test_shards_connect_what_all_pairs_connect(spark, crowd, monkeypatch):
    monkeypatch.setattr(hamming_trees, "SHARD", 200)
    signed = crowd.view(np.int64).tolist()
    prints = spark.createDataFrame([(x, 0) for x in signed], "fp long, least int").repartition(6)
    links = [(r.a, r.b) for r in hamming_trees.hamming_links(prints).collect()]
    at = {x: i for i, x in enumerate(signed)}
    pairs = {(min(at[a], at[b]), max(at[a], at[b])) for a, b in links}
    want = all_pairs(crowd, 3)
    assert pairs <= want and component_count(len(crowd), pairs) == component_count(len(crowd), want)


def test_near_copies_are_dropped(odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    found = {(x.component_id, x.fp if x.component_id is None else 0) for x in simhash.simhash_components(odd_docs).collect()}
    rows = kept.collect()
    assert len(rows) == len(found) and {1, 3} <= {x.doc_id for x in rows} and not {2, 4, 5} & {x.doc_id for x in rows}
    assert simhash.simhash_components(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


# resampling

def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_draw(rows, target):
    feats = [(d, *plain_features(t)) for d, t in rows]
    have, want = Counter(b for _, _, f in feats for b in f), Counter(b for t in target for b in plain_features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    out = []
    for d, n, f in feats:
        weight = sum(math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): i + 1 for i, x in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*x[:4], rank.get(id(x))) for x in out), key=repr)


def test_draws_equal_brute_force(spark, given):
    r = random.Random(3)
    rows = list(given) + [(7000 + i, " ".join(r.choice(["a1", "B", "é", "x-y", "_q_"]) for _ in range(r.randint(0, 40)))) for i in range(200)]
    rows += [(8000, None), (8001, ""), (8002, "..."), (None, "w " * 30), (8003, "one"), (8004, "one two"), (8005, "日本 日本 日本")]
    target = ["a1 b a1 b é é", None, "", "the lamps were lit"]
    docs = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, rank int, weight string").repartition(5)
    other = spark.createDataFrame([(t, 1) for t in target], "text string, n_words int")
    want = plain_draw(rows, target)
    for piece in (1 << 20, 50):
        got = sorted((tuple(x[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for x in resampling.resample(docs, other, piece=piece).collect()), key=repr)
        assert got == want
    assert max(x[4] or 0 for x in want) >= 15
    drawn = resampling.resampled_documents(docs, other)
    assert drawn.columns == [*docs.columns, "rank_"] and sorted(x.rank_ for x in drawn.collect()) == list(range(1, max(x[4] or 0 for x in want) + 1))


@settings(max_examples=200, deadline=None)
@cases(st.text(st.sampled_from("aB9 .é\x7f\n_"), max_size=60), st.integers(1, 20))
def test_pieces_hold_every_feature_once(text, piece):
    n, want = plain_features(text)
    got = list(resampling.scanned(text, piece))
    assert sum(k for k, _ in got) == n and Counter(b for _, x in got for b in x.tolist()) == Counter(want)


def test_draws_of_odd_tables(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    got = resampling.resample(odd_docs, target, percent=50, least_words=1).collect()
    able = [x for x in got if x.n_words >= 1]
    assert len(got) == len(odd_rows()) and sorted(x.rank for x in got if x.rank) == list(range(1, len(able) // 2 + 1))
    order = sorted(able, key=lambda x: (-x.score, x.doc_id is None, x.doc_id or 0))
    assert [x.score for x in sorted((x for x in got if x.rank), key=lambda x: x.rank)] == [x.score for x in order[: len(able) // 2]]
    assert resampling.resample(no_docs, target).count() == 0
    empty = resampling.resample(odd_docs, target.where("false")).agg(F.count("*")).first()[0]
    assert empty == len(odd_rows())
