"""One stream of the Mersenne Twister, read from any place on.

The published bootstraps draw all replicates from one ``random.Random``, so a
task that makes the thousandth replicate has to know the generator's state
there.  Words of the twister obey a linear recurrence over bits, so the word
``J`` places ahead is the exclusive or of those words among the next 19,937
whose coefficients in ``x ** J`` modulo the characteristic polynomial are one.
That polynomial is found from the generator's own bits (Berlekamp and Massey).
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Constants of MT19937.
WORDS, MIDDLE, DEGREE = 624, 397, 19937
TWIST, UPPER, LOWER = 0x9908B0DF, 0x80000000, 0x7FFFFFFF
#: Raw numbers made at once.
PIECE = 1 << 18


def first_key(seed: int | str) -> np.ndarray:
    """Words 0 .. 623 of ``random.Random(seed)``."""
    return np.array(random.Random(seed).getstate()[1][:-1], np.uint32)


def words(key: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` words of the recurrence, the key included; of many keys at once if each is a column."""
    out = np.empty((max(n, WORDS), *key.shape[1:]), np.uint32)
    out[:WORDS] = key
    at = WORDS
    while at < n:
        end = min(n, at + WORDS - MIDDLE)
        mixed = (out[at - WORDS : end - WORDS] & np.uint32(UPPER)) | (out[at - WORDS + 1 : end - WORDS + 1] & np.uint32(LOWER))
        out[at:end] = out[at - WORDS + MIDDLE : end - WORDS + MIDDLE] ^ (mixed >> np.uint32(1)) ^ ((mixed & np.uint32(1)) * np.uint32(TWIST))
        at = end
    return out[:n]


@lru_cache(1)
def characteristic() -> int:
    """The characteristic polynomial, bit ``k`` for ``x ** k``."""
    bits = (words(first_key(1), 2 * DEGREE + 2 * WORDS)[WORDS:] & 1).tolist()
    connection, before, length, gap, seen = 1, 1, 0, 1, 0
    for i, bit in enumerate(bits[: 2 * DEGREE]):
        seen = seen << 1 | bit
        if (connection & seen).bit_count() & 1:
            kept = connection
            connection ^= before << gap
            if 2 * length <= i:
                length, before, gap = i + 1 - length, kept, 0
        gap += 1
    assert length == DEGREE
    return int(bin(connection)[2:].zfill(DEGREE + 1)[::-1], 2)


_SPREAD = np.array([sum((b >> k & 1) << 2 * k for k in range(8)) for b in range(256)], "<u2")


def _reduced(v: int, rest: list[int]) -> int:
    while v.bit_length() > DEGREE:
        high = v >> DEGREE
        v &= (1 << DEGREE) - 1
        for e in rest:
            v ^= high << e
    return v


@lru_cache(64)
def power(steps: int) -> int:
    """``x ** steps`` modulo the characteristic polynomial."""
    phi = characteristic()
    rest = [k for k in range(DEGREE) if phi >> k & 1]
    out = 1
    for bit in bin(steps)[2:]:
        raw = np.frombuffer(out.to_bytes(DEGREE // 8 + 1, "little"), np.uint8)
        out = int.from_bytes(_SPREAD[raw].tobytes(), "little") << int(bit)
        out = _reduced(out, rest)
    return out


def key_after(key: np.ndarray, steps: int) -> np.ndarray:
    """The key, or each column's, ``steps`` words further on; of its first word only the top bit counts."""
    if not steps:
        return key
    ahead = words(key, DEGREE + WORDS)
    out = np.zeros_like(key)
    raw = np.frombuffer(power(steps).to_bytes(DEGREE // 8 + 1, "little"), np.uint8)
    for k in np.flatnonzero(np.unpackbits(raw, bitorder="little")):
        out ^= ahead[k : k + WORDS]
    return out


class Picks:
    """``random.Random(seed).randrange(n)`` again and again, as numpy arrays.

    ``start`` is how many raw numbers of the stream are left out; a pick takes
    one or more of them.
    """

    def __init__(self, n: int, seed: int | str, start: int = 0):
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": key_after(first_key(seed), start), "pos": WORDS}}
        self.words = np.random.Generator(self.bits)
        self.n, self.shift, self.left = n, np.uint32(32 - n.bit_length()), np.zeros(0, np.int64)

    def _raw(self, raws: int) -> np.ndarray:
        return self.words.integers(0, 1 << 32, raws, np.uint32)  # over the whole range these are the stream's own words

    def counted(self, raws: int) -> int:
        """How many picks the next ``raws`` raw numbers make."""
        return sum(int(np.count_nonzero((self._raw(min(PIECE, raws - a)) >> self.shift) < self.n)) for a in range(0, raws, PIECE))

    def accepted(self, raws: int) -> np.ndarray:
        """The picks that the next ``raws`` raw numbers make."""
        raw = self._raw(raws)
        raw >>= self.shift
        return raw[np.flatnonzero(raw < self.n)].astype(np.int64)

    def take(self, k: int) -> np.ndarray:
        """The next ``k`` picks."""
        parts, held = [self.left], len(self.left)
        while held < k:
            parts.append(self.accepted(min(PIECE, max(1024, int((k - held) * 1.2)))))
            held += len(parts[-1])
        found = np.concatenate(parts) if len(parts) > 1 else self.left
        out, self.left = found[:k], found[k:]
        return out

    def skip(self, k: int) -> None:
        """Leave out ``k`` picks, however many."""
        for a in range(0, k, PIECE):
            self.take(min(PIECE, k - a))


def _fixed(*values: int) -> list[np.ndarray]:
    return [np.array(v, np.uint32) for v in values]


class Lanes:
    """The raw numbers at many evenly spaced places of one stream, a column a place.

    numpy's generator makes one number at a time; here a step of the recurrence
    is taken at all places at once, which takes half the time or less.
    """

    def __init__(self, n: int, seed: int | str, start: int, stride: int, lanes: int):
        key = key_after(first_key(seed), start)[:, None]
        while (have := key.shape[1]) < lanes:
            key = np.concatenate((key, key_after(np.ascontiguousarray(key[:, : lanes - have]), have * stride)), 1)
        self.state = np.concatenate((key, key[:1]))  # the first word stands at the end again
        self.out = np.empty((WORDS, lanes), np.uint32)
        self.scratch = np.empty((2, WORDS - MIDDLE, lanes), np.uint32)
        self.shift = np.array(32 - n.bit_length(), np.uint32)

    def next(self) -> np.ndarray:
        """The next ``WORDS`` raw numbers of each place, cut to the bits of n; overwritten by the next call."""
        upper, twist, one, mask_b, mask_c, s7, s11, s15, s18 = _fixed(UPPER, TWIST, 1, 0x9D2C5680, 0xEFC60000, 7, 11, 15, 18)
        s = self.state
        for a, end, far in ((0, 227, 397), (227, 454, 0), (454, WORDS, 227)):
            x, y = self.scratch[:, : end - a]
            np.bitwise_xor(s[a:end], s[a + 1 : end + 1], x)
            np.bitwise_and(x, upper, x)
            np.bitwise_xor(x, s[a + 1 : end + 1], x)
            np.bitwise_and(x, one, y)
            np.multiply(y, twist, y)
            np.right_shift(x, one, x)
            np.bitwise_xor(x, y, x)
            np.bitwise_xor(s[far : far + end - a], x, s[a:end])
            if not a:
                s[WORDS] = s[0]
            out = self.out[a:end]  # tempered while the words are in the cache
            np.right_shift(s[a:end], s11, x)
            np.bitwise_xor(s[a:end], x, out)
            for by, mask in ((s7, mask_b), (s15, mask_c)):
                np.left_shift(out, by, x)
                np.bitwise_and(x, mask, x)
                np.bitwise_xor(out, x, out)
            np.right_shift(out, s18, x)
            np.bitwise_xor(out, x, out)
            np.right_shift(out, self.shift, out)
        return self.out
