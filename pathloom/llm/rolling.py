"""Karp-Rabin hashes of word sequences over the bytes of a text, as array operations.

They are polynomials modulo 2 ** 64, of which different sequences made for it can be equal: callers compare the words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below n, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, kept for the longest text so far up to a bound."""

    MOST = 1 << 21

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, min(2 * len(self.up), self.MOST))
            up, down = _powers(_BASE, size), _powers(_INVERSE, size)
            if size > self.MOST:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Rolled:
    """Prefix sums over the bytes of a sequence of words, joined by spaces."""

    def __init__(self, words: list[bytes], powers: Powers):
        joined = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        up, self.down = powers.to(len(joined) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(joined * up[:-1], dtype=np.uint64)])
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])

    def grams(self, n: int) -> np.ndarray:
        """The hash of each ``n`` consecutive words; equal sequences have equal hashes in every text."""
        starts, ends = self.starts[: max(0, len(self.ends) - n + 1)], self.ends[n - 1 :]
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hashes of the ``n`` words from each of some starts."""
        starts, ends = self.starts[at], self.ends[at + n - 1]
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(words: list[bytes], n: int, powers: Powers) -> np.ndarray:
    return Rolled(words, powers).grams(n) if len(words) >= n else np.zeros(0, np.uint64)
