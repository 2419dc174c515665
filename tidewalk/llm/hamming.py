"""SimHash fingerprints of any width and their pivot distance tables.

A pivot table has each fingerprint's Hamming distances to a set of reference fingerprints.  Two fingerprints within a radius have
coordinates that differ by the radius at most, whatever the reference (triangle inequality), so the largest coordinate
difference discards pairs without looking at the fingerprints; the rest is verified on them.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit word for each run of hashes that begins at ``starts``: a bit is 1 if over half of the run's hashes have it."""
    ends = np.r_[starts[1:], len(h)]
    parts = -(-(ends - starts) // 255)  # a byte lane counts to 255
    first = np.r_[0, np.cumsum(parts)[:-1]]
    at = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    bits = np.empty((len(starts), 8, 8), dtype=bool)  # [run, byte, bit of a byte]
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        bits[:, :, bit] = 2 * np.add.reduceat(lanes, first, axis=0, dtype=np.int64) > (ends - starts)[:, None]
    return np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()


def wide(h: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of ``words`` 64-bit words, a row for each run of hashes; every word hashes the hashes anew."""
    return np.stack([majority(mix64(h ^ seed), starts) for seed in mix64(np.arange(501, 501 + words, dtype=np.uint64))], axis=1)


def pivots(n: int, words: int = 1) -> np.ndarray:
    """``n`` reference fingerprints, by rule."""
    return mix64(np.arange(1, n * words + 1, dtype=np.uint64)).reshape(n, words)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint (a row of words) to every reference."""
    out = np.zeros((len(prints), len(refs)), dtype=np.int16)
    for k, ref in enumerate(refs):
        out[:, k] = np.bitwise_count(prints ^ ref).sum(axis=1)
    return out


def near(prints: np.ndarray, table: np.ndarray, left, right, radius: int) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) are within ``radius``: coordinate by coordinate, then exactly."""
    alive = np.arange(len(right))
    of = lambda x: x[alive] if isinstance(x, np.ndarray) else x
    for k in range(table.shape[1]):
        if not len(alive):
            break
        alive = alive[np.abs(table[of(left), k] - table[of(right), k]) <= radius]
    return alive[np.bitwise_count(prints[of(left)] ^ prints[of(right)]).sum(axis=1) <= radius]
