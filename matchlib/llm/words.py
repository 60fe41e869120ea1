"""Words of whole texts as hashes, without a Python step for each word."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """For what stands between white space, in lower case: the 8-byte hashes of its words (runs of letters and digits). Keeps what it has seen, up to a bound."""

    def __init__(self, most: int = 450_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> bytes:
        words = [token] if token.isalnum() else _WORD.findall(token)
        value = b"".join([xxhash.xxh3_64_digest(w.encode("utf-8", "replace")) for w in words])
        if len(self) >= self.most:
            self.clear()
        self[token] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The words' hashes (uint64), in order."""
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").lower().split())), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of words, in order; fewer words than n are one gram, none are none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    return out


WORDS = WordHashes()
