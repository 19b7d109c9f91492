"""Toxicity by class-conditional Kneser-Ney models of the spelling of words, with shared backoff counts."""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, stored, texts
from .words import letter_words

#: the sample a model is fitted on: rows of each class (those with the smallest hash of the key) and distinct words in all (the most frequent)
SAMPLE_ROWS, VOCABULARY = 2_500, 400_000
#: characters of an n-gram, discount of counts, words of a passage
ORDER, DISCOUNT, PASSAGE = 6, 0.75, 2
#: words and n-grams a Python worker remembers
MEMORY = 400_000


def grams(word: str) -> list[str]:
    """The n-grams of a word with its edges: each ends with the character it predicts; those at the beginning are shorter and start with ^."""
    padded = f"^{word}$"
    return [padded[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(padded))]


@dataclass
class Counts:
    """How often a gram, its context (all but the last character), and how many different characters follow the context."""
    gram: dict[str, int]
    total: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in self.gram.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        self.total, self.kinds = dict(total), dict(kinds)

    def smoothed(self, gram: str, lower: float) -> float:
        """Discounted share of the gram in its context, plus what the discount frees times the ``lower`` order's probability."""
        context = gram[:-1]
        total = self.total.get(context)
        if not total:
            return lower
        return (max(self.gram.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[context] * lower) / total


@dataclass
class Model:
    ordinary: Counts
    toxic: Counts
    shared: Counts
    characters: int
    slope: float = 1.0
    level: float = 0.0

    @cached_property
    def ratios(self) -> Ratios:
        """Made once in a Python worker, so that its later tasks find the words of the earlier ones."""
        return Ratios(self)

    def backoff(self, gram: str) -> float:
        """Shared probability of the last character: continuation counts of both classes together, down to single characters."""
        lower = self.backoff(gram[1:]) if len(gram) > 1 else 1 / self.characters
        return self.shared.smoothed(gram, lower)

    def log_ratio(self, gram: str) -> float:
        lower = self.backoff(gram[1:])
        return math.log(self.toxic.smoothed(gram, lower) / self.ordinary.smoothed(gram, lower))

    def passage(self, text: str) -> float:
        """The largest mean log-likelihood ratio a word, toxic against ordinary, of PASSAGE adjacent words; 0 without words."""
        found = letter_words(text)
        if not found:
            return 0.0
        v = np.fromiter(map(self.ratios.__getitem__, found), np.float64, len(found))
        n = min(PASSAGE, len(v))
        sums = np.r_[0.0, np.cumsum(v)]
        return float((sums[n:] - sums[:-n]).max()) / n

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.passage(text) - self.level), -700, 700))))


class Ratios(dict):
    """Word -> log-likelihood ratio of its spelling, remembered in bounded memory as are the n-grams'."""

    def __init__(self, model: Model):
        self.model, self.grams = model, {}

    def __missing__(self, word: str) -> float:
        known, total = self.grams, 0.0
        for g in grams(word):
            r = known.get(g)
            if r is None:
                if len(known) > MEMORY:
                    known.clear()
                known[g] = r = self.model.log_ratio(g)
            total += r
        if len(word) <= 48:
            if len(self) > MEMORY:
                self.clear()
            self[word] = total
        return total


def models(words: Iterable[tuple[str, int, int]]) -> Model:
    """From (word, count in ordinary texts, count in toxic texts)."""
    counts = (defaultdict(int), defaultdict(int))
    for word, *ns in words:
        found = grams(word)
        for y, n in enumerate(ns):
            if n:
                for g in found:
                    counts[y][g] += n
    shared: Counter[str] = Counter()
    level = set(counts[0]) | set(counts[1])
    characters = len({g[-1] for g in level}) + 1
    while level:
        below = Counter(g[1:] for g in level if len(g) > 1)
        shared.update(below)
        level = set(below)
    return Model(Counts(dict(counts[0])), Counts(dict(counts[1])), Counts(dict(shared)), characters)


def calibrated(model: Model, passages: np.ndarray, toxic: np.ndarray) -> Model:
    """Slope and level of the score: a logistic fit in one variable with equal weight of both classes, by Newton's method with a ridge."""
    if len(set(toxic.tolist())) < 2:
        model.slope, model.level = (1.0, 5.0)
        return model
    centre, spread = passages.mean(), passages.std() + 1e-9
    x = (passages - centre) / spread
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        e, w = weight * (toxic - p), weight * p * (1 - p) + 1e-9
        g = np.array([(e * x).sum() - 0.1 * a, e.sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -2, 2)
    a = max(a, 1e-3)
    model.slope, model.level = a / spread, centre - b / a * spread
    return model


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """text, toxic, fold (0 to 4) of at most about SAMPLE_ROWS labelled rows of each class, chosen by the hash of the key."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).where("k is not null and toxic in (0, 1)")
    rows = rows.withColumn("h", F.xxhash64(F.col("k").cast("string")))
    chosen = F.lit(False)
    for toxic, n in rows.groupBy("toxic").count().collect():
        top = int(-(2**63) + 2**64 * min(1.0, SAMPLE_ROWS / n)) - (n <= SAMPLE_ROWS)
        chosen = chosen | ((F.col("toxic") == toxic) & (F.col("h") <= F.lit(min(top, 2**63 - 1))))
    picked = stored(rows.where(chosen).select("k", "toxic", F.pmod("h", F.lit(5)).cast("int").alias("fold")).limit(4 * SAMPLE_ROWS), "labels")
    return stored(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "k").select("text", "toxic", "fold"), "sample")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of labelled rows (``labels``: key and label; rows without either, or with another label than 0 and 1, are left out).

    Four fifths of the sample give the counts, one fifth the level at which the score is 0.5. Words are counted in Spark.
    """
    rows = sample(docs, labels, key, text, label)
    words = rows.where("fold > 0").select("toxic", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
    top = counts.orderBy(F.desc(F.col("n0") + F.col("n1")), "word").limit(VOCABULARY)
    model = models((r[0], r[1], r[2]) for r in top.collect())
    found = passages(rows.where("fold = 0"), model, "text", toxic="toxic").toArrow()
    return calibrated(model, found.column("passage").to_numpy(), found.column("toxic").to_numpy())


def passages(rows: DataFrame, model: Model, text: str, **columns: Column | str) -> DataFrame:
    """``columns`` of every row, and passage and score of its text."""
    picked = rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()], F.col(text).cast("string").alias("_text"))
    shared, names = rows.sparkSession.sparkContext.broadcast(model), list(columns)

    def start():
        m = shared.value

        def step(batch: pa.RecordBatch):
            found = [m.passage(t) for t in texts(batch, "_text")]
            score = 1 / (1 + np.exp(-np.clip(m.slope * (np.array(found) - m.level), -700, 700)))
            return [*[batch.column(n) for n in names], pa.array(found, pa.float64()), pa.array(score, pa.float64())]
        return step

    kept = "".join(f"{n} {picked.schema[n].dataType.simpleString()}, " for n in columns)
    return arrow_pass(picked, f"{kept}passage double, score double", start)


def toxicity(docs: DataFrame, model: Model, text: str = "text", **columns: Column | str) -> DataFrame:
    """``columns`` of every row of ``docs``, score (0 to 1) and predicted (1 if the score is at least 0.5).

    The score follows from the text's most toxic passage of PASSAGE words: the mean log-likelihood ratio of its words' spelling. Null and
    empty texts score as a passage of ratio 0 does. Texts are read whole, in one pass without a shuffle; repeated rows are scored each; other
    columns don't matter. The model, of bounded size, is sent to each task once.
    """
    return passages(docs, model, text, **columns).select(*columns, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
