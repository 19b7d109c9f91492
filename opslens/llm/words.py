"""Words of long texts in pieces, so that memory follows the piece and not the text."""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import regex

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: bytes of a text that are split into words at a time
PIECE = 4 << 20


def chunks(data: bytes, most: int = PIECE) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes that end at white space; a longer word stays whole."""
    start = 0
    while len(data) - start > most:
        cut = SPACE.search(data, start + most)
        if cut is None:
            break
        yield data[start : cut.start()]
        start = cut.end()
    yield data[start:]


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, piece by piece (bytes.split() splits at just these)."""
    for piece in chunks(data):
        yield piece.split()


def word_names(data: bytes) -> np.ndarray:
    """An integer for each word of a text in order; equal words have equal ones."""
    names: defaultdict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    return np.concatenate([np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in word_lists(data)])


#: runs of what ``re`` can tell from digits and marks; beside letters it takes numbers such as ½ or Ⅷ
_NEAR = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def letter_words(text: str) -> list[str]:
    """Runs of letters (Unicode category L) of ``text`` in lower case."""
    found = _NEAR.findall(text.lower())
    if found and not "".join(found).isalpha():
        return [w for x in found for w in ([x] if x.isalpha() else _LETTERS.findall(x))]
    return found
