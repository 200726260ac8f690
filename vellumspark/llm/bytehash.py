"""Vectorised 64-bit hashes of byte ranges, by prefix sums of a polynomial modulo 2**64 and a bijective finish."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class Ranges:
    """Hashes of ranges of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def sliding(self, k: int) -> np.ndarray:
        """The hashes of all ranges of length k."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])
