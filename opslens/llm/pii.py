"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes."""
from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .spans import span_rows

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
#: what a field position may look at on its own: words with a digit or an at sign; all other words are outside any span
TRIGGER = re.compile(r"[0-9@]")
EDGES = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """The base kinds' spans: leftmost, not overlapping within a kind, failing matches dropped without another try.

    An address is LOCAL characters, an at sign and a DOMAIN. Starts within one run of digits or LOCAL characters fail or match
    alike, so only the first is tried and long runs cost no more than their length.
    """
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append(("email", a, m.end(), True))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                found.append(("ip", m.start(), m.end(), True))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end(), True))
        if "+" in text:
            found += [("phone", m.start(), m.end(), True) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def word_around(text: str, at: int) -> tuple[int, int]:
    a, b = at, at + 1
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return a, b


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of adjacent trigger words of a line, as (start, end) of each word."""
    found: list[list[tuple[int, int]]] = []
    m = TRIGGER.search(text)
    while m:
        a, b = word_around(text, m.start())
        if found and text[found[-1][-1][1] : a].strip(" \t") == "":
            found[-1].append((a, b))
        else:
            found.append([(a, b)])
        m = TRIGGER.search(text, b)
    return found


@lru_cache(maxsize=100_000)
def shape(word: str) -> str:
    """Letters as a or A, digits as 9; runs of letters shortened to two, of digits kept up to five."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word)
    s = re.sub(r"\d", "9", s)
    s = re.sub(r"(a|A)\1{2,}", r"\1\1", s)
    return re.sub(r"9{6,}", lambda m: "9" * 5 + ("+" if len(m[0]) < 13 else "++" if len(m[0]) <= 19 else "+++"), s)[:40]


def features(text: str, run: Sequence[tuple[int, int]]) -> list[list[str]]:
    """Names of the features of each word of a run: its shape and its parts, and the shapes of the words beside it."""
    a, b = run[0][0], run[-1][1]
    before, after = text[max(0, a - 40) : a].split(), text[b : b + 40].split()
    words = [text[x:y] for x, y in run]
    around = [before[-1].strip(EDGES).lower() if before else "^", *words, after[0].strip(EDGES).lower() if after else "$"]
    shapes = [around[0], *[shape.__wrapped__(w) if len(w) > 40 else shape(w) for w in words], around[-1]]
    found = []
    for i, w in enumerate(words, 1):
        core = w.strip(EDGES)
        digits = len(DIGIT.findall(core))
        found.append(["bias", f"shape={shapes[i]}", f"core={shape(core[:40])}", f"digits={min(digits, 20)}", f"at={'@' in core}", f"dots={min(core.count('.'), 4)}",
                      f"plus={w.startswith('+')}", f"paren={w.startswith('(')}", f"dash={min(core.count('-'), 3)}", f"alpha={any(c.isalpha() for c in core)}",
                      f"prev={shapes[i - 1][:24]}", f"next={shapes[i + 1][:24]}"])
    return found


@dataclass
class Field:
    """Weights of a linear-chain CRF: names maps a feature to its row in emit; label 0 is outside."""
    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emissions(self, feats: Sequence[Sequence[str]]) -> np.ndarray:
        out = np.zeros((len(feats), len(self.first)))
        for i, f in enumerate(feats):
            rows = [self.names[x] for x in f if x in self.names]
            if rows:
                out[i] = self.emit[rows].sum(0)
        return out

    def decode(self, batch: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many runs at once: runs of one length form a numpy batch."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, e in enumerate(batch):
            by_length[len(e)].append(i)
        labels: list[np.ndarray] = [np.zeros(0, int)] * len(batch)
        for n, members in by_length.items():
            e = np.stack([batch[i] for i in members])
            score, back = self.first + e[:, 0], []
            for t in range(1, n):
                step = score[:, :, None] + self.move
                back.append(step.argmax(1))
                score = step.max(1) + e[:, t]
            path = [(score + self.last).argmax(1)]
            for b in reversed(back):
                path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
            for i, p in zip(members, np.stack(path[::-1], 1), strict=True):
                labels[i] = p
        return labels


def labelled_table(seed: int = 11, copies: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): a small labelled table, made from sentence frames and a seeded generator of values."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda n=6: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, n)))

    def card() -> str:
        n = "4" + d(14)
        n += next(c for c in "0123456789" if luhn(n + c))
        return r.choice([n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4))])

    values = {
        "email": lambda: f"{w()}{r.choice(['', '.', '_', '+'])}{r.choice([w(), d(2)])}@{w()}{r.choice(['', d(1)])}.{r.choice(['com', 'org', 'example.com', 'net', 'fr'])}",
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(20, 99)} {d(3)} {d(4)} {d(3)}", f"{r.randint(200, 999)}-{d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} ({d(2)}) {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]),
    }
    others = [lambda: str(r.randint(0, 99999)), lambda: f"{r.randint(1, 999)},{d(3)}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
              lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}", lambda: f"{r.randint(1, 99)}%", lambda: f"{w()}{d(2)}",
              lambda: f"{d(2)} {d(2)}", lambda: f"{d(3)} {d(4)}", lambda: f"@{w()}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"({r.randint(1, 99)})", lambda: f"{d(1)}.{d(2)}", lambda: d(r.choice([6, 8, 10, 13, 16, 18])),
              lambda: f"{d(4)} {d(4)}", lambda: f"{w()}={''.join(r.choice('0123456789abcdef') for _ in range(r.randint(16, 40)))}", lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(20)), lambda: f"{d(3)}-{d(2)}", lambda: f"{w()}@{w()}", lambda: f"{d(2)}/{d(2)}/{d(4)}"]
    frames = ["{}", "{} {x}", "call {} or", "write to {}.", "the {x} of {}, and", "{x}. {x} {} {x}", "from {} to {x}", "contact: {}", "({})", "{x} {x} {}"]
    table = []
    for kind in [*values, *["outside"] * 6]:
        for i in range(copies * len(frames)):
            value = values[kind]() if kind in values else others[(i + r.randrange(3)) % len(others)]()
            head, _, tail = frames[i % len(frames)].partition("{}")
            head, tail = (re.sub(r"\{x\}", lambda _: w(), x) for x in (head, tail))
            table.append((head + value + tail, [(kind, len(head), len(head) + len(value))] if kind in values else []))
    return table


def fit(table: Sequence[tuple[str, Sequence[tuple[str, int, int]]]], rounds: int = 120, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Conditional log-likelihood of the labelled runs, climbed with AdaGrad; gradients by forward-backward over numpy batches of one length."""
    examples = []
    for text, spans in table:
        for run in runs(text):
            y = [next((1 + KINDS.index(k) for k, s, e in spans if a < e and s < b), 0) for a, b in run]
            examples.append((features(text, run), y))
    names: dict[str, int] = {}
    for f, _ in examples:
        for x in (n for word in f for n in word):
            names.setdefault(x, len(names))
    k, by_length = len(KINDS) + 1, defaultdict(list)
    for f, y in examples:
        by_length[len(y)].append(([[names[x] for x in word] for word in f], y))
    groups = [(np.array([f for f, _ in g]), np.array([y for _, y in g])) for g in by_length.values()]
    shapes = [(len(names), k), (k, k), (k,), (k,)]
    theta, seen = [np.zeros(s) for s in shapes], [np.full(s, 1e-6) for s in shapes]
    log_sum = lambda x, axis: np.logaddexp.reduce(x, axis)
    for _ in range(rounds):
        emit, move, first, last = theta
        grad = [-ridge * len(examples) * t for t in theta]
        for f, y in groups:
            e, n = emit[f].sum(2), y.shape[1]
            alpha = [first + e[:, 0]]
            for t in range(1, n):
                alpha.append(log_sum(alpha[-1][:, :, None] + move, 1) + e[:, t])
            beta = [np.broadcast_to(last, alpha[-1].shape)]
            for t in range(n - 1, 0, -1):
                beta.append(log_sum(move + (e[:, t] + beta[-1])[:, None, :], 2))
            beta.reverse()
            z = log_sum(alpha[-1] + last, 1)[:, None]
            for t in range(n):
                off = np.eye(k)[y[:, t]] - np.exp(alpha[t] + beta[t] - z)
                np.add.at(grad[0], f[:, t].ravel(), np.repeat(off, f.shape[2], 0))
                if t == 0:
                    grad[2] += off.sum(0)
                if t == n - 1:
                    grad[3] += off.sum(0)
                else:
                    both = alpha[t][:, :, None] + move + (e[:, t + 1] + beta[t + 1])[:, None, :] - z[:, :, None]
                    grad[1] -= np.exp(both).sum(0)
                    np.add.at(grad[1], (y[:, t], y[:, t + 1]), 1)
        for t, s, g in zip(theta, seen, grad, strict=True):
            s += g * g
            t += rate * g / np.sqrt(s)
    return Field(names, *theta)


def field_spans(batch: Sequence[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of adjacent words with one label, without the punctuation around them."""
    where, emissions = [], []
    for i, text in enumerate(batch):
        for run in runs(text):
            where.append((i, run))
            emissions.append(field.emissions(features(text, run)))
    found: list[list[tuple[str, int, int, bool]]] = [[] for _ in batch]
    for (i, run), labels in zip(where, field.decode(emissions), strict=True):
        t = 0
        while t < len(run):
            u = t
            while u + 1 < len(run) and labels[u + 1] == labels[t]:
                u += 1
            if labels[t]:
                a, b = run[t][0], run[u][1]
                while a < b and batch[i][a] in EDGES.replace("(", ""):
                    a += 1
                while b > a and batch[i][b - 1] in EDGES:
                    b -= 1
                a += batch[i][a:b].startswith("(") and ")" not in batch[i][a:b]
                if b > a:
                    found[i].append((KINDS[labels[t] - 1], a, b, False))
            t = u + 1
    return found


def pii_spans(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base) of every row of ``docs``.

    Base spans come from the patterns; the field adds spans that overlap no base span. Words without a digit or an at sign are outside by
    the field's definition, so that only runs of the others are decoded, with the words beside them as features. Null and empty
    texts have no spans; texts are read whole; repeated rows are each read. Other columns of ``docs`` don't matter. No shuffle.
    """
    def start():
        def find(batch: list[str]):
            spans = [base_spans(t) for t in batch]
            for own, more in zip(spans, field_spans(batch, field), strict=True):
                own += [m for m in more if not any(s[1] < m[2] and m[1] < s[2] for s in own)]
            return spans
        return find

    return span_rows(docs, key, text, start)
