"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from wardline.llm.frames import LOWER_BYTES, mix64

_BASE = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words; it starts anew when it has ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER_BYTES).split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; a shorter text is one window, no words is none."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    size = min(size, n)
    with np.errstate(over="ignore"):
        rolled = h[:n - size + 1]
        for i in range(1, size):
            rolled = rolled * _BASE + h[i:n - size + 1 + i]
    return np.unique(mix64(rolled + np.uint64(size)))
