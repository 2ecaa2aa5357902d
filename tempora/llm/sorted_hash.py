"""Look-ups in sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np


class Finder:
    """Rows of keys in a sorted array of hashes; the leading bits give the first row that can hold a key."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, ~np.uint64(0))
        bits = int(len(self.keys)).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def rows(self, key: np.ndarray) -> np.ndarray:
        """The row of each key; the row past the last one if there is none."""
        row = self.first[key >> self.shift]
        miss = np.flatnonzero(self.keys[row] != key)
        if len(miss):
            row[miss] = np.minimum(np.searchsorted(self.keys, key[miss]), len(self.keys) - 1)
            row[miss[self.keys[row[miss]] != key[miss]]] = len(self.keys) - 1
        return row
