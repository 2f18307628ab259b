"""Words (runs of anything but the six ASCII white-space characters) and hashes of word windows."""

from __future__ import annotations

import numpy as np
import xxhash

KEPT_HASHES = 250_000  # word hashes a task keeps; past that it starts anew, which changes no result
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word's bytes, kept for words already seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "u8", len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a one-to-one finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, in order of position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, "u8")
    h = np.zeros(n, "u8")
    for i in range(size):
        h = h * STEP + hashes[i:i + n]
    return mixed(h)
