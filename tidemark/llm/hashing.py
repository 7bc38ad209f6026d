"""Hashes of many character and word runs at once, in numpy.

A running polynomial sum modulo 2**64 gives the hash of any run by one subtraction and one
multiplication. Codes are scrambled before they enter, and results after they leave.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xC2B2AE3D27D4EB4F
NONE = np.uint64(2**64 - 1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.array([base % 2**64], np.uint64)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        step = step * step
        done += take
    return out


class Roller:
    """Hashes of runs of a code array. ``base`` must be odd. Tables grow with the longest array seen."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = powers(self.base, self.n), powers(self.inverse, self.n)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Running sums of already scrambled codes; one longer than ``codes``."""
        n = len(codes)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hash of every run of ``length`` codes."""
        m = len(prefix) - length
        if m <= 0:
            return np.zeros(0, np.uint64)
        return scramble((prefix[length:] - prefix[:m]) * self.down[:m])

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((prefix[end] - prefix[start]) * self.down[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in two passes over blocks whatever the width."""
    n = len(x)
    if n < width:
        return x[:0]
    block = np.full((-(-n // width) + 1) * width, NONE, np.uint64)
    block[:n] = x
    block = block.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])
