"""Near duplicates and repeated strings against brute force."""
import random

import numpy as np

from opslens.llm import near_dedup, suffix_dedup

from odd import PASSAGE, given, no_docs, odd_docs, odd_rows  # noqa: F401, I001


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force(spark, given):
    r = random.Random(3)
    base, other = given[1][1].split()[:80], given[2][1].split()[:90]
    rows = list(given)
    rows += [(1000 + i, edited(base, r, i % 5)) for i in range(40)]  # larger than SMALL, not all alike
    rows += [(2000 + i, PASSAGE + " " + " ".join(f"own{i}x{j}" for j in range(20 + i))) for i in range(30)]  # share a passage only
    rows += [(3000, " ".join(other)), (3001, " ".join(other)), (3002, "a b"), (3003, "a b"), (3004, "a c")]
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, node int, class string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()}
    assert got == near_dedup.brute_force(rows)
    assert len({got[1000 + i] for i in range(40)}) < 40 and len({got[2000 + i] for i in range(30)}) == 30


def classes(spark, rows):
    return {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}


def changed(words, r, n, own):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"{own}x{i}"
    return " ".join(words)


def test_copies_alike_only_by_their_original_are_one_class(spark):
    r = random.Random(11)
    original = [f"word{r.randrange(10**6)}" for _ in range(1000)]
    rows = [(0, " ".join(original))] + [(i, changed(original, r, 33, f"own{i}")) for i in range(1, 601)]
    seqs = [near_dedup.shingle_hashes(near_dedup.word_hashes(t, near_dedup.Words())) for _, t in rows[:40]]
    assert not any(near_dedup.similar(a, b, 0.8) for i, a in enumerate(seqs[1:]) for b in seqs[1 : i + 1])
    want = near_dedup.brute_force(rows)
    assert set(want.values()) == {0}
    assert classes(spark, rows) == want


def test_large_groups_of_many_classes_equal_brute_force(spark, monkeypatch):
    r = random.Random(12)
    common = [f"word{r.randrange(10**6)}" for _ in range(210)]
    rows = []
    for i in range(60):  # 70 % the same in all, so that groups are large, but only the three of a kind are similar
        own = [f"kind{i}x{j}" for j in range(90)]
        rows += [(10 * i + k, changed(common + own, r, 4, f"own{i}k{k}")) for k in range(3)]
    want = near_dedup.brute_force(rows)
    assert len(set(want.values())) == 60
    assert classes(spark, rows) == want
    monkeypatch.setattr(near_dedup, "BLOCK", 40)  # a second tier, and blocks where that leaves larger groups
    assert classes(spark, rows) == want
    monkeypatch.setattr(near_dedup, "WEIGHT", 3000)  # blocks of few long texts
    assert classes(spark, rows) == want


def test_estimates_far_below_the_overlap_are_still_aligned():
    v = np.arange(1, 400, dtype=np.uint32)
    both, one, other, above = v[:142], v[142:256:2], v[143:256:2], v[256:]
    x, y = np.r_[both, one, above[::2][:57]].tobytes(), np.r_[both, other, above[1::2][:57]].tobytes()
    assert near_dedup.overlap(x, y) == 142 / 256  # of texts of an overlap of 2/3, 3.8 standard deviations below it
    assert near_dedup.may_be_similar(x, y, 0.8) and not near_dedup.may_be_similar(x, y, 0.9)


def test_a_repeated_shingle_leaves_the_labels_of_the_others():
    once, twice = np.array([5, 7, 9], np.uint64), np.array([5, 7, 9, 7], np.uint64)
    assert near_dedup.labelled(once).tolist() == near_dedup.labelled(twice)[:3].tolist() and len(set(near_dedup.labelled(twice).tolist())) == 4


def test_odd_rows_are_classes_of_their_own(odd_docs, no_docs):
    found = near_dedup.near_duplicates(odd_docs).collect()
    assert len(found) == len(odd_rows())
    assert sorted((x.doc_id, x.class_id, x.class_size, x.kept) for x in found if x.class_size > 1) == [
        (-5, -5, 2, True), (1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (8, 8, 3, True), (9, 8, 3, False), (13, 8, 3, False), (2**60, -5, 2, False)]
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows()) - 5
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_alignment_counts_the_longest_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (r.integers(0, 6, r.integers(1, 30)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert near_dedup.aligned(a, b, 40) == table[-1, -1]
        for share in (0.5, 0.8):
            assert near_dedup.similar(a, b, share) == (table[-1, -1] >= share * max(len(a), len(b)) - 1e-9)


def removed(spark, docs, rows):
    got = sorted((x.doc_id, [(s.start, s.end) for s in x.spans]) for x in suffix_dedup.without_repeats(docs).collect() if x.doc_id is not None)
    want = suffix_dedup.brute_force([(d, t.encode()) for d, t in rows])
    assert got == sorted(want.items())


def test_removed_strings_equal_brute_force(spark, given, monkeypatch):
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = list(given)
    rows += [(1000 + i, "".join(r.choice("xyz ") for _ in range(r.randint(0, 60))) + line[r.randint(0, 20) : r.randint(90, 150)] + f"{r.random()}" * 3) for i in range(80)]
    rows += [(1100, "ab" * 300), (1101, "a" * 500), (1102, "ba" * 200), (1103, line + line), (1104, ""), (1105, "é" * 120 + line)]
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, ord int, h string")
    removed(spark, docs, rows)
    monkeypatch.setattr(suffix_dedup, "GROUP", 5)  # the way for grams with very many surroundings
    removed(spark, docs, rows)


def test_odd_texts(odd_docs, no_docs):
    found = suffix_dedup.without_repeats(odd_docs).collect()
    assert len(found) == len(odd_rows())
    by = {x.doc_id: x for x in found if x.doc_id not in (2, None)}
    assert by[12].n_removed == 69999 and by[11].n_removed == 798 and by[9].n_removed == len(PASSAGE) and by[4].n_bytes == 0
    assert sum(x.n_removed for x in found if x.doc_id in (1, 2)) == 0  # shorter than a string
    assert suffix_dedup.without_repeats(no_docs).count() == 0


def test_interval_tree_gives_left_diverse_repeats():
    cut = [(t[:i][::-1], t[i:]) for t, i in ((b"xxabcdefgh1", 4), (b"yyabcdefgh2", 4), (b"xyabcdefgh2", 4))]
    found = {(left, right, tuple(sorted(m))) for left, right, m in suffix_dedup.maximal_repeats(cut, 6)}
    assert found == {(2, 6, (0, 1, 2)), (3, 6, (1, 2)), (3, 7, (1, 2))} or found >= {(2, 6, (0, 1, 2)), (3, 7, (1, 2))}
