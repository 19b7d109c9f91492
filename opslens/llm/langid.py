"""Language identification: known words by log frequency, unseen ones by progressively shorter character n-grams."""
from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_pass, keyed, materialized, only_rows, stored, texts
from .words import letter_words

#: the sample a model is fitted on: rows of each language (those with the smallest hash of the key) and words in all (the most frequent)
SAMPLE_ROWS, VOCABULARY = 2_000, 150_000
#: lengths of n-grams, longest first; of each length the most frequent are kept
LENGTHS, GRAMS = (5, 4, 3, 2, 1), 60_000
#: unseen words a task remembers
MEMORY = 400_000
UNKNOWN = "und"


@dataclass
class Model:
    """words and grams hold a row number of their table each; a table's row has one log frequency a language."""
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_logs: dict[int, np.ndarray]

    @cached_property
    def scorer(self) -> Scorer:
        """Made once in a Python worker, so that its later tasks find the words of the earlier ones."""
        return Scorer(self)

    def backed_off(self, word: str) -> np.ndarray:
        """Mean log frequencies of the longest n-grams of ``word`` that the model knows; zeros if it knows none."""
        padded = f"^{word}$"
        for n in LENGTHS:
            known, total, found = self.grams[n], 0.0, 0
            for a in range(0, len(padded) - n + 1, 4096):  # long runs in pieces
                rows = [known[g] for i in range(a, min(a + 4096, len(padded) - n + 1)) if (g := padded[i : i + n]) in known]
                if rows:
                    total, found = total + self.gram_logs[n][rows].sum(0), found + len(rows)
            if found:
                return total / found
        return np.zeros(len(self.languages))


def _logs(counts: dict[str, np.ndarray], keys: list[str], languages: int, smooth: float) -> np.ndarray:
    table = np.array([counts[k] for k in keys], float).reshape(len(keys), languages)
    return np.log((table + smooth) / (table.sum(0) + smooth * max(1, len(keys))))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages of ``docs`` (rows without text or language are left out).

    Words are counted in Spark over at most SAMPLE_ROWS rows of each language; the VOCABULARY most frequent words are the known
    ones. N-grams are counted over the known words, each once in a language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).cast("string").alias("text")).dropna(subset=["lang", "text"])
    # the hash below which each language has its sample, from hashes alone: texts are never sorted
    limits = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r.lang for r in limits)
    bound = None
    for r in limits:
        # hashes are uniform: the share of the hash range that holds the sample
        top = int(-(2**63) + 2**64 * min(1.0, SAMPLE_ROWS / r.n)) - (r.n <= SAMPLE_ROWS)
        one = (F.col("lang") == r.lang) & (F.col("h") <= F.lit(min(top, 2**63 - 1)))
        bound = one if bound is None else bound | one
    counts: dict[str, np.ndarray] = {}
    if languages:
        found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
        seen = rows.where(bound).select("lang", F.explode(found).alias("word")).groupBy("word").pivot("lang", languages).count().na.fill(0)
        top = seen.orderBy(F.desc(sum(F.col(f"`{x}`") for x in languages)), "word").limit(VOCABULARY)
        counts = {r[0]: np.array(r[1:], float) for r in top.collect()}
    words = list(counts)
    grams: dict[int, dict[str, int]] = {}
    logs: dict[int, np.ndarray] = {}
    for n in LENGTHS:
        tally: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        for w in words:
            there = counts[w] > 0
            padded = f"^{w}$"
            for i in range(len(padded) - n + 1):
                tally[padded[i : i + n]] += there
        keys = [k for k, _ in Counter({k: v.sum() for k, v in tally.items()}).most_common(GRAMS)]
        grams[n], logs[n] = {k: i for i, k in enumerate(keys)}, _logs(tally, keys, len(languages), 0.5)
    return Model(languages, {w: i for i, w in enumerate(words)}, _logs(counts, words, len(languages), 0.1), grams, logs)


class Scorer(dict):
    """Word -> row of ``logs``. Unseen words are scored once and remembered, in bounded memory."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known = model, len(model.words)
        self.logs = np.concatenate([model.word_logs.reshape(self.known, len(model.languages)), np.zeros((1024, len(model.languages)))]).astype(np.float32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs[: max(1024, row // 2)])])
        self.logs[row] = self.model.backed_off(word)
        self[word] = row
        return row

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest language and its share of the posterior; the evidence of n words counts as that of sqrt(n)."""
        found = letter_words(text)
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        rows = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        total = self.logs[rows].sum(0, dtype=np.float64) / np.sqrt(len(found))
        if len(self) > self.known + MEMORY:
            self.clear()
            self.update(self.model.words)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def predictions(docs: DataFrame, model: Model, text: str = "text", **columns: Column | str) -> DataFrame:
    """``columns`` of every row of ``docs``, and lang_pred, score.

    Only the text counts; words are runs of letters (Unicode category L). Null texts and texts without a letter are ``und`` with score 0, and so are all if the model knows no language;
    ties go to the first language in name order. Texts are read whole, in one pass without a shuffle. The model is of bounded size and
    sent to each task once. Repeated rows are scored each; other columns don't matter.
    """
    rows = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()], F.col(text).cast("string").alias("_text"))
    shared, names = docs.sparkSession.sparkContext.broadcast(model), list(columns)

    def start():
        scorer = shared.value.scorer

        def step(batch: pa.RecordBatch):
            found = [scorer.predict(t) for t in texts(batch, "_text")]
            return [*[batch.column(n) for n in names], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
        return step

    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in columns)
    return arrow_pass(rows, f"{kept}, lang_pred string, score double", start)


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, mod n; null keys have remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def in_known_language(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without the rows in no language: ``und``, or a best share below ``least`` (no language stands out)."""
    docs = materialized(docs)
    found = keyed(docs, _t=text)
    judged = predictions(found, model, "_t", **{n: n for n in ROW})
    rejected = judged.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(*ROW)
    return only_rows(docs, stored(rejected, "rejected"), "left_anti")
