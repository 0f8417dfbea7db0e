"""Word shingles as 64-bit values, computed with numpy over the bytes of one text at a time.

A word's hash is a polynomial over its bytes (difference of prefix sums times the inverse power of its start), finished
with a bijective mixer; a shingle's hash is a weighted sum of its words' hashes, mixed again.
"""

from __future__ import annotations

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64) | 1 for j in range(16)], dtype=np.uint64)

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        out = []
        for b in (BASE, INVERSE):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each run of bytes other than ASCII white space, in order."""
    return spaced_words(data)[0]


def spaced_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they begin."""
    a = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([False], ~WHITE[a], [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = _power_tables(len(a) + 1)
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, with repeats, in order; fewer words make one shingle of all; none make none."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out += words[j : n - width + 1 + j] * WEIGHTS[j % 16]
    return mix(out)


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(data), k))
