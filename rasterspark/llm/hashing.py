"""Polynomial hashes modulo 2**64 of byte or word sequences, vectorised.

A prefix array P has P[i] = sum of v[j] * B**j for j < i. The window [i, j) then has the
position-free value (P[j] - P[i]) * B**-i. The values v are drawn from a 64-bit mixer, and
`mix` spreads the result over all bits.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=None)
def byte_values(seed: int = 1) -> np.ndarray:
    """256 odd values, one for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE + 2 * seed)) | np.uint64(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n (at least), kept between calls."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 21, n)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _powers[name] = np.cumprod(values)
    return _powers["up"], _powers["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * powers(len(p))[1][start])


def windows(p: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of that width; empty if the sequence is shorter."""
    n = len(p) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((p[width:] - p[:n]) * powers(len(p))[1][:n])


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
