"""Array kernels shared by the text operators.

Everything here works on one Arrow batch inside a task.  Texts are joined into
one byte buffer and cut into pieces of a bounded size, so a task's memory
depends on the piece size and on the longest single text, not on the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 21
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z:
#: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words ``[^\x20\x09-\x0D]+``.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(1, dtype=U)
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(int(base), len(have), 1 << 64))])
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=U))[0])


def as_bytes(column) -> list:
    """UTF-8 bytes of a string column of a batch; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts: list, limit: int = PIECE):
    """(start, end) of runs of texts of about ``limit`` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of a list of texts: byte spans, 64-bit hashes, and each text's range.

    ``text``: lower-cased bytes of all texts with a blank after each;
    ``start``, ``end``, ``hash``: of each word; ``first[i]:first[i+1]``: the words of text i.
    """

    def __init__(self, texts: list, inside: np.ndarray):
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        low = LOWER[raw]
        mask = inside[low]
        change = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if len(mask) and mask[0]:
            change = np.concatenate([[0], change])
        self.text = low
        self.start, self.end = change[0::2], change[1::2]
        self.hash = _span_hashes(low, self.start, self.end)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, begins)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The text index of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, i: int) -> bytes:
        return self.text[self.start[i]:self.end[i]].tobytes()

    def phrase(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1, joined by single blanks."""
        return b" ".join(self.word(j) for j in range(i, i + n))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every run of n words that stays inside one text."""
        total = len(self) - n + 1
        if total <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        h = np.zeros(total, dtype=U)
        for j in range(n):
            h = h * U(0xD6E8FEB86659FD93) + self.hash[j:j + total]
        last = np.repeat(self.first[1:], self.count)[:total]
        at = np.flatnonzero(np.arange(total) + n <= last)
        return at, mix(h[at] + U(n))


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Position-independent 64-bit hashes of byte spans, by prefix sums of a polynomial.

    The buffer is walked in steps that end between spans, so the 8-byte prefix
    sums never cover more than a step (or one longer span)."""
    out = np.empty(len(start), dtype=U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        sums = np.zeros(b - a + 1, dtype=U)
        np.cumsum((data[a:b].astype(U) + U(1)) * _power_table(_BASE, b - a), out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        h = (sums[e] - sums[s]) * _power_table(_BASE_INV, b - a)[s]
        out[i:j] = mix(h + (e - s).astype(U) * U(0xA24BAED4963EE407))
        i = j
    return out


def gram_hash(words: list, n: int) -> int:
    """The hash that ``Words.grams`` gives these n lower-cased words."""
    w = Words([b" ".join(words)], VISIBLE)
    return int(w.grams(n)[1][0])


class Members:
    """Fast test of many hashes against a fixed set: a bit table first, then a binary search."""

    def __init__(self, values):
        self.values = np.unique(np.asarray(list(values), dtype=U))
        bits = max(16, min(24, int(len(self.values)).bit_length() + 6))
        self.shift = U(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.values >> self.shift] = True

    def where(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(at) or not len(self.values):
            return at[:0]
        found = np.searchsorted(self.values, hashes[at])
        found[found == len(self.values)] = 0
        return at[self.values[found] == hashes[at]]


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over first[i]:first[i+1]; 0 for an empty range."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
