"""Word shingles as sets of 64-bit hashes, computed inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words of a batch; at most ``limit`` at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a combined hash over all 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between white space with A-Z lower-cased; bytes methods know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    width = min(k, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        x = mix(x * MULTIPLIER + h[j : len(h) - width + 1 + j])
    return np.unique(x)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
