"""A wavelet matrix over an integer sequence; all queries take arrays and answer them together."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Counts, selects and finds successors by value within ranges of positions, one step for each bit of the values."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max()).bit_length()) if self.n else 1
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            z = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(~one, out=z[1:])
            self.zeros.append(z)
            values = np.concatenate([values[~one], values[one]])

    def below(self, l: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of positions l..r-1 are smaller than x."""
        full, count = x >= 1 << self.bits, np.zeros(len(l), dtype=np.int64)
        width = r - l
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1)):
            zl, zr = z[l], z[r]
            one = (x >> b & 1).astype(bool)
            count += np.where(one, zr - zl, 0)
            l, r = np.where(one, z[-1] + l - zl, zl), np.where(one, z[-1] + r - zr, zr)
        return np.where(full, width, count)

    def smallest(self, l: np.ndarray, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) among positions l..r-1."""
        out = np.zeros(len(l), dtype=np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1)):
            zl, zr = z[l], z[r]
            one = k >= zr - zl
            k = np.where(one, k - (zr - zl), k)
            out |= one.astype(np.int64) << b
            l, r = np.where(one, z[-1] + l - zl, zl), np.where(one, z[-1] + r - zr, zr)
        return out

    def successor(self, l: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x among positions l..r-1; -1 if there is none."""
        k = self.below(l, r, x)
        out, some = np.full(len(l), -1, dtype=np.int64), np.flatnonzero(k < r - l)
        out[some] = self.smallest(l[some], r[some], k[some])
        return out

    def predecessor(self, l: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The largest value below x among positions l..r-1; -1 if there is none."""
        k = self.below(l, r, x)
        out, some = np.full(len(l), -1, dtype=np.int64), np.flatnonzero(k > 0)
        out[some] = self.smallest(l[some], r[some], k[some] - 1)
        return out
