"""Words and their hashes as arrays, over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls while small."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 19:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Polynomial hashes of any run of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray, salt: int = 0):
        n = len(values)
        odd = np.uint64((int(_P) * (2 * salt + 1)) & (2**64 - 1))
        self.up = powers(f"up{salt}", odd, n + 1)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(f"down{salt}", inverse, n + 1)[:n], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[starts:ends]; equal runs of equal length have equal hashes."""
        return mix((self.sums[ends] - self.sums[starts]) * self.up[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` values."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


def spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and offsets of the texts in words.

    ``offsets`` are the texts' places in ``raw``; a word never reaches over the end of its text.
    """
    inside = is_word[raw]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[a_at:a_at+length] equals b[b_at:b_at+length], for many runs of length > 0."""
    out = np.ones(len(lengths), bool)
    ends = np.cumsum(lengths)
    k = 0
    while k < len(lengths):  # a few MB at a time
        base = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, base + (1 << 21), side="right")))
        size = lengths[k:stop]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = a[np.repeat(a_at[k:stop], size) + within] == b[np.repeat(b_at[k:stop], size) + within]
        out[k:stop] = np.logical_and.reduceat(same, np.cumsum(size) - size)
        k = stop
    return out
