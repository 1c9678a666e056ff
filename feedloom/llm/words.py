"""Words and sentences, as all operators of this subpackage read them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The lower-cased words; a null text has none."""
    return " ".join(WORD.findall(text)).lower().split(" ") if text and WORD.search(text) else []


class WordHashes(dict):
    """64-bit hashes of words, kept while a task runs; `limit` bounds the memory, not what is hashed."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, one for each start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        x = np.zeros(n, np.uint64)
        for i in range(width):
            x = mixed(x * _MIX[0] + hashes[i : i + n])
    return x
