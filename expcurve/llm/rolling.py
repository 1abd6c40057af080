"""Polynomial hashes of word windows, vectorised over many documents."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words; equal windows have equal hashes wherever they stand."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:len(hashes)], dtype=np.uint64)])
        return mixed((sums[length:] - sums[:-length]) * down[:n])
