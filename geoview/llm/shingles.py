"""Words and word shingles as 64-bit numbers, the same in every process.

Words are the runs of letters, digits and underscores of the lower-cased text.
A shingle is ``size`` words in a row; a text with fewer words, but any, has one
shingle of all of them; a text without words has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import xxhash

from .common import claim

SIZE = 5
#: Words in one generation of a worker's memo; it holds two generations at most.
MEMO_ENTRIES = 300_000
#: Characters of a text that are taken apart at once.
SLICE_CHARS = 1 << 20
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    def __init__(self) -> None:
        super().__init__()
        self._old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        h = self._old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h

    def turn(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self._old = dict(self)
            self.clear()


@lru_cache(maxsize=1)
def _memo() -> _Memo:
    return _Memo()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(text: str, size: int) -> Iterator[str]:
    """``text`` in slices of about ``size`` characters, which end at white space;
    words, and the lower case of each, are the same as in the whole."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if len(text) - at > size else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of one text, which is read in slices."""
    memo, find = _memo(), _WORD.findall
    parts = []
    for part in slices(text or "", SLICE_CHARS):
        memo.turn()
        parts.append(np.array([memo[w] for w in find(part.lower())], dtype=np.uint64))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def word_hashes(texts: Iterable[str | None]) -> list[np.ndarray]:
    claim("shingles", _memo.cache_clear)
    return [words_of(t) for t in texts]


def shingle_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One number for each shingle, in order."""
    k = min(size, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * _ODD
        h ^= h >> np.uint64(29)
    return mix(h)
