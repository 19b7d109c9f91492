"""Secrets in texts: fixed patterns, and character Markov models that tell random strings from ordinary identifiers."""
from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import span_rows

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
#: documents from which letter-only words are taken as further ordinary strings, and words taken from each, when a model is fitted
SAMPLE_ROWS, SAMPLE_WORDS = 500, 400

# The patterns of the base kinds, the least length of what they must hold, and the words the keyword pattern begins with.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: what the models score: runs of these characters of at least this length
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{18,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: words of which the ordinary sample's identifiers are made
IDENTIFIER_WORDS = (
    "get set add user name value index count data list item file path read write open close start stop time date string number text line "
    "page view model table column row key node tree graph order price total event handler request response server client connection "
    "database query result error message config option default current previous next last first update delete create insert select "
    "from where group join left right inner outer session account address email phone country language version release build test "
    "package module class function method object array vector matrix buffer stream thread process memory cache queue stack").split()


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """The base kinds' spans: leftmost, not overlapping within a kind, failing matches dropped."""
    found, low = [], text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end(), True) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [("hex", m.start(), m.end(), True) for m in HEX.finditer(text)]


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 for a random one and 0 for an ordinary identifier), made by rule from a seeded generator."""
    r = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = [lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-", lower + digits, upper + digits]
    rows = []
    for _ in range(n):
        letters = r.choice(alphabets)
        rows.append(("".join(r.choice(letters) for _ in range(r.randint(18, 64))), 1))
        parts = [r.choice(IDENTIFIER_WORDS) for _ in range(r.randint(2, 7))]
        style = r.randrange(6)
        text = ("_".join(parts) if style == 0 else "-".join(parts) if style == 1 else "/".join(parts) if style == 2
                else "".join(p.capitalize() for p in parts) if style == 3 else "_".join(parts).upper() if style == 4 else "".join(parts))
        rows.append((text + (r.choice(["", "_", "-"]) + str(r.randint(0, 9999)) if r.random() < 0.4 else ""), 0))
        if r.random() < 0.1:
            rows += [("-".join(f"{r.randint(1, 9999):0{r.randint(1, 4)}d}" for _ in range(r.randint(3, 6))), 0), (r.choice("-=_/") * r.randint(18, 80), 0)]
    return rows


@dataclass
class MarkovPair:
    """Two second-order character models as one table of log-likelihood ratios, and the decision level."""
    ratio: np.ndarray
    level: float

    def scores(self, strings: list[str]) -> np.ndarray:
        """Mean log-likelihood ratio a character, random against ordinary, of each string (of CANDIDATE's characters)."""
        if not strings:
            return np.zeros(0)
        code = CODE[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
        ends = np.cumsum([len(s) for s in strings])
        starts = ends - [len(s) for s in strings]
        a, b = np.roll(code, 2), np.roll(code, 1)
        a[starts], b[starts] = 0, 0
        second = starts[ends - starts > 1] + 1
        a[second] = 0
        return np.add.reduceat(self.ratio[a, b, code], starts) / (ends - starts)


CODE = np.zeros(256, np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)


def _model(strings: Iterable[str]) -> np.ndarray:
    """log P(c | a, b): second-order counts backed off to first order, to single characters and to uniform (Witten-Bell weights)."""
    n = len(ALPHABET) + 1
    counts = np.zeros((n, n, n))
    for s in strings:
        c = CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(counts, (np.r_[0, 0, c[:-2]][: len(c)], np.r_[0, c[:-1]], c), 1)
    p = np.full(n, 1 / n)
    for table in (counts.sum((0, 1)), counts.sum(0), counts):
        total, kinds = table.sum(-1, keepdims=True), (table > 0).sum(-1, keepdims=True)
        p = (table + (kinds + 1) * p) / (total + kinds + 1)
    return np.log(p)


def fit(samples: Iterable[tuple[str, int]], spare: float = 0.0005) -> MarkovPair:
    """Models of both labels; the level leaves at most ``spare`` of a held-back fifth of the ordinary samples above it, and is 0.4 at least."""
    rows = [(s, y) for s, y in samples if s and all(c in ALPHABET for c in s)]
    fit_rows = [x for i, x in enumerate(rows) if i % 5]
    pair = MarkovPair(_model(s for s, y in fit_rows if y) - _model(s for s, y in fit_rows if not y), 0.0)
    held = pair.scores([s for i, (s, y) in enumerate(rows) if not i % 5 and not y and len(s) >= 18])
    pair.level = max(0.4, float(np.quantile(held, 1 - spare)) + 0.1 if len(held) else 0.0)
    return pair


def ordinary_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Letter-only words of a bounded sample of ``docs`` as ordinary samples, in three spellings.

    At most SAMPLE_ROWS rows (those with the smallest hash of the key) and SAMPLE_WORDS long words of each.
    """
    hashed = docs.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    highest = hashed.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if highest is None:
        return []
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{9,}"), F.lit(0)))
    picked = hashed.where(F.col("h") <= highest).select(F.slice(words, 1, SAMPLE_WORDS).alias("w")).limit(SAMPLE_ROWS)
    words = sorted({w for r in picked.collect() for w in r.w})
    return [(v, 0) for w in words for v in (w, w.upper(), w + w.lower())]


def secret_spans(docs: DataFrame, model: MarkovPair, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base) of every row of ``docs``.

    Base kinds: assign, access, hex. Kind random: a run of token characters that holds a letter, does not overlap a base span,
    and whose mean log-likelihood ratio is above the model's level. Null and empty texts have no spans; texts are
    scanned whole; repeated rows are each scanned. Other columns of ``docs`` don't matter. No shuffle.
    """
    def start():
        def find(batch: list[str]):
            spans = [base_spans(t) for t in batch]
            where, strings = [], []
            for i, t in enumerate(batch):
                for m in CANDIDATE.finditer(t):
                    a, b = m.span()
                    if not any(s[1] < b and a < s[2] for s in spans[i]) and not m[0].strip("0123456789+/_=-") == "":
                        where.append((i, a, b))
                        strings.append(m[0])
            for (i, a, b), score in zip(where, model.scores(strings), strict=True):
                if score > model.level:
                    spans[i].append(("random", a, b, False))
            return spans
        return find

    return span_rows(docs, key, text, start)
