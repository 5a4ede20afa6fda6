"""Sync points of byte windows: what makes a depth-limited radix sort of all suffixes affordable."""

from __future__ import annotations

import numpy as np

DEPTH, GRAM = 200, 32
BLOCK = 1 << 19

_RNG = np.random.default_rng(8191)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_P), k, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolled:
    """Hashes of all stretches of any wanted length of a byte string, by doubling."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _BYTE[data]}

    def of(self, length: int) -> np.ndarray:
        """One for each start; empty if the string is shorter."""
        if length not in self.by:
            half = 1 << (length - 1).bit_length() - 1 if length & (length - 1) else length // 2
            a, b = self.of(half), self.of(length - half)
            n = max(0, len(self.by[1]) - length + 1)
            self.by[length] = a[:n] * _power(length - half) + b[half : half + n]
        return self.by[length]


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def sync_points(text: bytes):
    """(g, m, a, z, c) of a text's windows of DEPTH bytes, as arrays, blockwise.

    The windows that start at a to z share the sync point m, the place of the least hashed gram in the
    window (the first, if some are equal): it depends on the window's bytes alone, so that equal windows
    have it at the same place. g is the hash of that gram, c of the bytes of all windows from a to z.
    """
    data = np.frombuffer(text, np.uint8)
    starts = len(data) - DEPTH + 1
    for base in range(0, starts, BLOCK):
        n = min(BLOCK, starts - base)
        rolled = Rolled(data[base : base + n + DEPTH - 1])
        gram = mixed(rolled.of(GRAM))
        place = np.arange(len(gram), dtype=np.uint64)
        least = least_of((gram & ~np.uint64((1 << 20) - 1)) | place, DEPTH - GRAM + 1) & np.uint64((1 << 20) - 1)
        a = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        z = np.append(a[1:], len(least)) - 1
        m = least[a].astype(np.int64)
        whole = rolled.of(DEPTH)
        c = mixed(mixed(whole[a]) * np.uint64(3) + mixed(whole[z] + np.uint64(7)) + (z - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(gram[m]))
        # The bytes from a to z + DEPTH are those of the two windows at its ends, as z - a < DEPTH.
        yield gram[m], m + base, a + base, z + base, c
