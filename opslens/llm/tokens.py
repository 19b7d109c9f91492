"""Token counts by heap-and-linked-list byte-pair merging."""
from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, texts

SPACE = "▁"
#: distinct words a Python worker remembers, and the longest it remembers, in code points
CACHE_WORDS, CACHE_LENGTH = 1_000_000, 48
_CHUNKS = re.compile(" *[^ ]+| +")


@lru_cache(maxsize=4)
def merge_ranks(model_path: str) -> dict[str, float]:
    """Piece -> rank (lower merges first) of a sentencepiece BPE model; control, unknown and byte pieces are no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def merged_count(chunk: str, ranks: dict[str, float]) -> int:
    """Tokens of a chunk of text whose spaces are already SPACE.

    The symbols form a doubly linked list; a heap holds the adjacent pairs whose concatenation is a piece. The pair
    of lowest rank (the leftmost of equal ones) is merged until none is left. A character without a piece
    stands for its UTF-8 bytes, as byte fallback has it.
    """
    n = len(chunk)
    symbols: list[str | None] = list(chunk)
    weight = [1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in chunk]
    count = sum(weight)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(chunk[i : i + 2])) is not None]
    heapq.heapify(heap)
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    while heap:
        _, i, size = pop(heap)
        left = symbols[i]
        if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != size:
            continue  # one of the two has been merged meanwhile
        count += 1 - weight[i] - weight[j]
        symbols[i], weight[i] = left + symbols[j], 1
        symbols[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(symbols[i] + symbols[k])) is not None:
                push(heap, (r, i, size + len(symbols[k])))
        h = before[i]
        if h >= 0 and (r := get(symbols[h] + symbols[i])) is not None:
            push(heap, (r, h, len(symbols[h]) + size))
    return count


class Counter(dict):
    """Word (without its leading space) -> tokens. Words are remembered in a dictionary of bounded size."""

    def __init__(self, model_path: str):
        self.ranks = merge_ranks(model_path)

    def __missing__(self, word: str) -> int:
        n = merged_count(SPACE + word.replace(" ", SPACE), self.ranks)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """No piece has a space after another character, so that the chunks of spaces and a word merge apart."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        return sum(self[c[1:]] for c in _CHUNKS.findall(" " + text))


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> Counter:
    """One counter per Python worker, so that its later tasks find the words of the earlier ones."""
    return Counter(model_path)


def token_counts(docs: DataFrame, model_path: str, key: Column | str = "doc_id", text: Column | str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens; a text of spaces has the tokens of its spaces. Rows that
    repeat, or whose key is null, are counted each. Very long texts cost n log n steps of the heap. Other columns of
    ``docs`` don't matter. No shuffle: each task reads its rows and keeps only the merge table and a bounded memory of words.
    """
    key, text = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    rows = docs.select(key.alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def start():
        counter = counter_of(model_path)

        def step(batch: pa.RecordBatch):
            n = [counter.count(t) for t in texts(batch, "text")]
            return [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
        return step

    return arrow_pass(rows, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", start)
