"""Monotone sequences in Elias-Fano form, on numpy arrays that may be memory-mapped.

A value is split into low bits, packed side by side, and a high part, coded in
unary: element i sets bit (high + i).  Bucket h of equal high parts lies
between the h-1st and the h-th zero, so a successor search is two selects and
a binary search among the few elements of one bucket.
"""

from __future__ import annotations

import numpy as np

from .kernels import U

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Position of the k-th zero bit of a byte.
_ZERO = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if not _b >> p & 1):
        _ZERO[_b, _k] = _p


class EliasFano:
    """A sorted uint64 sequence; ``arrays`` holds everything, in a form that can be written and mapped again."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> U(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(at[-1]) + 2 if n else 1) // 64) * 64 + 64
        flags = np.zeros(size, dtype=np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little")
        words = _POP[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - words)]).astype(np.int64)
        low = np.zeros(n * bits // 64 + 2, dtype=U)
        if bits and n:
            part, bit = values & U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = bit >> 6, (bit & 63).astype(U)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        return cls(n, bits, low, high, zeros)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th zero."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left, eight = (k - self.zeros[word]).astype(np.int16), self.high.reshape(-1, 8)[word]
        free = np.cumsum(8 - _POP[eight], axis=1, dtype=np.int16)
        j = np.minimum((free <= left[:, None]).sum(axis=1), 7)
        row = np.arange(len(k))
        left -= np.where(j > 0, free[row, np.maximum(j - 1, 0)], 0)
        return word * 64 + 8 * j + _ZERO[eight[row, j], left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=U)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(U)
        value = self.low[word] >> shift
        carry = (U(64) - shift) & U(63)
        value = value | np.where(shift > 0, self.low[word + 1] << carry, U(0))
        return value & U((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element >= x, whether it equals x); queries beyond the last high part give n."""
        out, equal = np.full(len(x), self.n, dtype=np.int64), np.zeros(len(x), dtype=bool)
        if not self.n or not len(x):
            return out, equal
        buckets = int(self.zeros[-1])
        rest = np.flatnonzero((x >> U(self.low_bits)) < U(buckets))
        h = (x[rest] >> U(self.low_bits)).astype(np.int64)
        low = x[rest] & U((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(rest), dtype=U)
        end = self._zero(h) - h
        begin = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        lo, hi = np.minimum(begin, self.n), np.minimum(end, self.n)
        stop = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        out[rest] = lo
        inside = np.flatnonzero(lo < stop)
        equal[rest[inside]] = self._low(lo[inside]) == low[inside]
        return out, equal


def write_levels(path: str, sequences: dict, arrays: dict) -> None:
    """One file: a header line and the arrays of every level, 8-byte aligned."""
    import json
    flat, spec = [], {}
    for k, e in sequences.items():
        spec[k] = [e.n, e.low_bits]
        flat += [(f"{k}.low", e.low), (f"{k}.high", e.high), (f"{k}.zeros", e.zeros)]
    flat += list(arrays.items())
    place, at = {}, 0
    for k, a in flat:
        place[k] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"spec": spec, "place": place}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for _, a in flat:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def map_levels(path: str) -> tuple[dict, dict]:
    """(sequences, arrays) of a file, memory-mapped."""
    import json
    raw = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))  # a plain view of the mapping
    size = int(raw[:8].view(np.uint64)[0])
    meta = json.loads(raw[8:8 + size].tobytes())
    get = lambda k: raw[8 + size + meta["place"][k][0]:][:np.dtype(meta["place"][k][1]).itemsize * meta["place"][k][2]].view(meta["place"][k][1])
    seqs = {k: EliasFano(n, bits, get(f"{k}.low"), get(f"{k}.high"), get(f"{k}.zeros")) for k, (n, bits) in meta["spec"].items()}
    return seqs, {k: get(k) for k in meta["place"] if "." not in k}
