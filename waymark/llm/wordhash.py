"""Hashes of the words of many texts at once, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C55 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers that tell the places of a shingle's words apart.
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more).

    Words are maximal runs of bytes other than ASCII white space, with A-Z in
    lower case; null texts have none.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~SPACE[data]
    broken = np.zeros(size + 1, bool)  # a text begins here
    broken[edges] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | broken[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | broken[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _table(size + 1)
    letters = (LOWER[data] if lower else data).astype(np.uint64)
    letters += np.uint64(1)
    letters *= up[:size]
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(letters, out=sums[1:])
    hashes = (sums[last] - sums[first]) * down[first]
    hashes = mix(hashes + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(first, edges)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on (for all places that have so many)."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += words[j : j + n] * PLACES[j]
    return mix(out)
