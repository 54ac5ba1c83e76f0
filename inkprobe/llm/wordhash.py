"""Vectorised word hashes over concatenated UTF-8 texts."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = pow(int(_BASE), -1, 1 << 64)
_BYTES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

# Byte tables: A-Z to lower case; 1 for word bytes.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
NOT_BLANK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ALPHANUMERIC = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _powers_of(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, none across texts, and the number of words of each text."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = word_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: equal for equal bytes wherever they stand."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers_of("up", int(_BASE), len(data)), out=sums[1:])
    down = _powers_of("down", _INVERSE, len(data) + 1)
    return mix64((sums[ends] - sums[starts]) * down[starts])


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the first ``size`` bytes of each run (all bytes of a shorter one)."""
    total = np.zeros(len(starts), dtype=np.uint64)
    for k in range(size):
        at = starts + k
        there = at < ends
        total[there] += _BYTES[data[at[there]]] * np.uint64(pow(int(_BASE), k, 1 << 64))
    return mix64(total)
