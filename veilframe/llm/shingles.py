"""Hashes of words, word windows and shingle sets, the same in every worker."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from veilframe.llm.common import remembers

#: Words that a worker remembers; a full cache is emptied, which costs time only.
CACHE_WORDS = 150_000

FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words on end, and each list's length."""
        if len(self) > CACHE_WORDS:
            self.clear()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.uint64, int(counts.sum())), counts


#: One cache a worker process, whichever operator runs in it.
WORDS = WordHashes()
remembers("words", WORDS.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each `width` consecutive values; some cross texts, so the caller masks them."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += hashes[i : n + i] * FACTORS[i]
    return mix(out)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The best of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = best(out[: len(out) - step], out[step:]), have + step
    return out


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words has one, without words none."""
    every = windows(hashes, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(every[at : at + n - width + 1]))
        else:
            out.append(windows(hashes[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out
