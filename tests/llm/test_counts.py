"""Token counts, exact duplicates, mixing and decontamination on odd tables."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import sentencepiece
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from opslens.llm import decontaminate, exact_dedup, mixing, sql, tokens

from odd import PASSAGE, given, no_docs, odd_docs, odd_rows  # noqa: F401, I001

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@cases(st.text(st.sampled_from(" aethn▁\n\t.<s>é日\U0001f600́"), max_size=60))
def test_counts_equal_the_tokenizer(text):
    assert tokens.counter_of(MODEL).count(text) == len(PIECES.encode(text))


def test_token_counts_of_odd_texts(odd_docs, no_docs):
    got = sorted((repr(tuple(r)) for r in tokens.token_counts(odd_docs, MODEL, limit=10).collect()))
    want = []
    for d, t, *_ in odd_rows():
        n = len(PIECES.encode(t or ""))
        want.append(repr((d, len((t or "").encode()), n, n > 10)))
    assert got == sorted(want)
    assert tokens.token_counts(no_docs, MODEL).count() == 0


def test_exact_duplicates_with_small_blocks(odd_docs, no_docs):
    rows = exact_dedup.duplicates(odd_docs, block=8).collect()
    groups = defaultdict(list)
    for d, t, *_ in odd_rows():
        groups[t or ""].append(d)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(rows) == len(odd_rows())
    for r in rows:
        members = groups[sha[r.text_sha256]]
        assert r.group_size == len(members)
        assert r.keep_id == max((d for d in members if d is not None), default=None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(list(sha))  # one row of each group, also of rows that agree in all
    assert exact_dedup.duplicates(no_docs).count() == 0


def test_rows_that_repeat_lose_all_but_one(odd_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t, *_ in odd_rows()})


def test_block_names_tell_shifted_texts_apart(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = exact_dedup.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=3).collect()
    last = {t: i for i, t in enumerate(texts)}
    assert all(x.keep_id == last[texts[x.doc_id]] and x.group_size == texts.count(texts[x.doc_id]) for x in rows)


def test_mix_equals_sql_on_odd_rows(spark, odd_docs, no_docs):
    one_each = odd_docs.dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", one_each.select("doc_id", "text", "source").toArrow())
    want = con.execute(sql.MIXING).fetchall()
    got = [tuple(x) for x in mixing.mix(one_each).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert mixing.mix(no_docs).count() == 0


def test_targets_are_filled_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 0
    assert abs(sum(got.values()) - 1.5 * 1110) < 1e-6


def test_mix_repeats_and_stays_near_its_targets(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(1, 30), f"s{i % 4 if i % 3 else 0}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = ({x.doc_id: (x.taken, x.size, x.target, x.source_size) for x in mixing.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert a == b
    by_source = defaultdict(list)
    for i, _, s in rows:
        by_source[s].append(a[i])
    for found in by_source.values():
        assert abs(sum(x[0] for x in found) - found[0][2]) <= 30
        assert all(t <= 2 * n for t, n, *_ in found)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == [*docs.columns, "copies"] and copies.count() == sum(x[0] > 0 for x in a.values())


def contained(docs, items, share=0.8):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def shingles(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    found = []
    for d, t in docs:
        for i, x in items:
            n = min(5, len(words(x)))
            s, own = shingles(words(x), n) if n else set(), shingles(words(t), n)
            if s and len(s & own) >= share * len(s) - 1e-9:
                found.append((d, i, len(s), len(s & own)))
    return sorted(map(repr, found))


def test_items_in_documents_equal_brute_force(spark, odd_docs, no_docs, given):
    words = PASSAGE.split()
    items = [(1, PASSAGE), (1, PASSAGE), (2, None), (3, "the Quick brown"), (7, "a-b c d"), (8, "it3"), (9, "#"), (10, "nobody spoke a word"), (None, "word1 it1 word2 it2 word3 it3"), (4, " ".join(words[:14] + ["other"])),
             (5, " ".join(words[:10] + ["these", "are", "quite", "other", "words"])), (6, given[0][1][:300])]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, hash string")
    docs = odd_docs.select("doc_id", "text", "spans", "h").unionByName(spark.createDataFrame([(*g, "x", 1) for g in given], "doc_id long, text string, spans string, h long"))
    got = decontaminate.contained_items(docs, bench).select("doc_id", "item_id", "n_shingles", "n_shared").collect()
    want = contained([*[(d, t) for d, t, *_ in odd_rows()], *given], items)
    assert sorted(repr(tuple(r)) for r in got) == want and want
    # the SQL twin groups by keys, so each row has its own here
    docs = spark.createDataFrame(list(enumerate([t for _, t, *_ in odd_rows()] + [t for _, t in given])), "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(items)], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    twin = con.execute(sql.DECONTAMINATION).fetchall()
    found = decontaminate.contained_items(docs, bench).select("doc_id", "item_id", "n_shingles", "n_shared", "containment").collect()
    assert sorted(map(tuple, found)) == sorted(twin) and {items[x[1]][0] for x in twin} >= {3, 8, 10}
    clean = decontaminate.decontaminated(odd_docs, bench.where("length(text) > 25"))
    assert clean.columns == odd_docs.columns
    assert sorted(repr(r.text) for r in clean.collect()) == sorted(repr(t) for d, t, *_ in odd_rows() if d not in (8, 9, 10, 13))
    assert decontaminate.contained_items(no_docs, bench).count() == 0
    assert decontaminate.contained_items(odd_docs, bench.limit(0)).count() == 0
