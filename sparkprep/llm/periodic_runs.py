"""Periodic run detection (13): internal pattern matching over the words of each text.

A run of smallest period q is at least four periods long, so near its start it
holds an aligned (dyadic) block of m words, for m the power of two with
``(2 m - 1) / 3 <= q < (4 m - 1) / 3``, that occurs again q words further on.
The blocks' occurrences are looked up like this:

* Prefix doubling sorts the suffixes of all texts of a piece, each text on its
  own.  Its rank after j rounds names the word sequences of length 2**j, and a
  block is the suffix-array range of its name.
* A wavelet matrix over the suffix array answers range successor: the first,
  the second and the last occurrence of a block in the window that lies
  ``(2 m - 1) / 3 .. (4 m - 1) / 3`` words after it.  Blocks that occur once in
  their text are not asked for.
* The window is shorter than m, so its occurrences form one arithmetic
  progression.  One or two occurrences are candidate periods themselves.  Three
  or more differ by the block's own period d; the run then maps the stretch of
  period d around the block to the one around the progression, so the
  difference of their starts or of their ends is the only candidate.

Each candidate is stretched to the left and right by longest common extensions
over the ranks of all rounds.  Of several periods of one stretch the smallest
stays; a stretch counts if it is long enough.  Words are compared by exact
codes, never by hashes.

One text is one unit: a task holds some 100 bytes a word and round of its
longest text, other texts go in pieces of bounded size.

Defined cases: a null text has no words; a text without words has no runs and
an empty collapsed text; an id that is null repeats nothing; repeated rows are
treated one by one; an empty table gives an empty result; other columns pass
through ``collapse`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import VISIBLE, as_bytes, pieces
from .registry import read, register
from .wavelet import Wavelet
from .word_codes import codes, joined, word_array, word_spans

#: A run has at least so many periods and so many words.  Block sizes and windows rest on the first.
PERIODS, WORDS = 4, 6
PIECE_BYTES = 1 << 20


class Names:
    """Suffix array of texts and the names of all their word sequences of lengths 1, 2, 4, ...

    ``code``: the words of all texts; ``first[i]:first[i+1]``: text i.
    ``blocks``: for each length from 2, the aligned blocks that occur again in their text, as (start, from, to) in the suffix array."""

    def __init__(self, code: np.ndarray, first: np.ndarray):
        n = len(code)
        sizes = np.diff(first)
        self.begin, self.end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(code.max()) + 1) + code
        self.sa = np.argsort(key, kind="stable")
        head = _heads(key[self.sa])
        rank = np.empty(n, dtype=np.int64)
        rank[self.sa] = head
        self.ranks, self.blocks, self.again = [rank], [], None
        length = 1
        while True:
            slots = np.flatnonzero(_shared(head))
            if length == 2:
                self.again = slots
            if length > 1:
                self._keep_blocks(slots, head[slots], length)
            if not len(slots):
                break
            pos = self.sa[slots]
            after = pos + length
            then = np.where(after < self.end[pos], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[pos] * (n + 1) + then
            order = np.argsort(key, kind="stable")
            pos, key = pos[order], key[order]
            self.sa[slots] = pos
            head = head.copy()
            head[slots] = slots[_heads(key)]
            rank = rank.copy()
            rank[pos] = head[slots]
            self.ranks.append(rank)
            length *= 2
        if self.again is None:
            self.again = np.empty(0, np.int64)

    def _keep_blocks(self, slots: np.ndarray, head: np.ndarray, length: int) -> None:
        pos = self.sa[slots]
        at = np.flatnonzero(((pos - self.begin[pos]) % length == 0) & (pos + length <= self.end[pos]))
        start = np.searchsorted(head, head[at], side="left")
        self.blocks.append((pos[at], slots[start], slots[start] + np.searchsorted(head, head[at], side="right") - start))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, for i < j in one text."""
        got, end = np.zeros(len(i), dtype=np.int64), self.end[i]
        for k in range(len(self.ranks) - 1, -1, -1):
            size, a, b = 1 << k, i + got, j + got
            some = np.flatnonzero(b + size <= end)
            got[some[self.ranks[k][a[some]] == self.ranks[k][b[some]]]] += size
        return got

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal, for i < j in one text."""
        got, begin = np.zeros(len(i), dtype=np.int64), self.begin[i]
        for k in range(len(self.ranks) - 1, -1, -1):
            size = 1 << k
            a, b = i - got - size, j - got - size
            some = np.flatnonzero(a >= begin)
            got[some[self.ranks[k][a[some]] == self.ranks[k][b[some]]]] += size
        return got


def _heads(key: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with an equal key."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)


def _shared(head: np.ndarray) -> np.ndarray:
    same = head[1:] == head[:-1]
    out = np.zeros(len(head), dtype=bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _candidates(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): some run of each smallest period goes on from the place for a block and the period at least."""
    slot = np.zeros(len(names.sa) + 1, dtype=np.int64)
    slot[names.again + 1] = 1
    slot = np.cumsum(slot)  # ranges of sequences of two or more that recur, within the suffixes that do
    suffix = names.sa[names.again]
    tree = Wavelet(suffix - names.begin[suffix])
    places, periods = [], []
    for j, (s, l, r) in enumerate(names.blocks):
        m = 2 << j
        lo, hi = -(-(2 * m - 1) // 3), -(-(4 * m - 1) // 3)
        l, r = slot[l], slot[r]
        own = s - names.begin[s]
        f = tree.successor(l, r, own + lo)
        at = np.flatnonzero((f >= 0) & (f < own + hi))
        s, l, r, own, f = s[at], l[at], r[at], own[at], f[at]
        last = tree.predecessor(l, r, own + hi)
        places.append(s), periods.append(f - own)
        at = np.flatnonzero(last > f)
        s, l, r, own, f, last = s[at], l[at], r[at], own[at], f[at], last[at]
        g = tree.successor(l, r, f + 1)
        two = g == last
        places.append(s[two]), periods.append((g - own)[two])
        s, own, f, d = s[~two], own[~two], f[~two], (g - f)[~two]
        t = s + f - own
        for q in (t - names.back(t, t + d) - (s - names.back(s, s + d)), t + names.ahead(t, t + d) - (s + names.ahead(s, s + d))):
            fit = (q >= lo) & (q < hi)
            places.append(s[fit]), periods.append(q[fit])
    return np.concatenate(places or [names.sa[:0]]), np.concatenate(periods or [names.sa[:0]])


def runs(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period; starts count from the text's first word."""
    if not len(code):
        return (np.empty(0, np.int64),) * 4
    names = Names(code, first)
    s, q = _candidates(names)
    start, end = s - names.back(s, s + q), s + q + names.ahead(s, s + q)
    ok = end - start >= np.maximum(WORDS, PERIODS * q)
    start, end, q = start[ok], end[ok], q[ok]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    text = np.searchsorted(first, start, side="right") - 1
    order = np.lexsort((q, start))
    text, start, end, q = text[order], start[order], end[order], q[order]
    return text, start - first[text], end - start, q


def repeated(ids: list, sizes: np.ndarray) -> np.ndarray:
    """Where each word of the texts comes from, if the texts of every tenth checksum repeat a part of themselves."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.arange(first[-1])
    for k, i in enumerate(ids):
        n = int(sizes[k])
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[first[k] + a:first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return out


def _answers(texts: list, ids: list | None) -> dict:
    """The columns that ``find_runs`` adds, for one piece of texts."""
    raw, begins = joined(texts)
    s, e = word_spans(raw, VISIBLE)
    first = np.searchsorted(s, begins)
    words = word_array(raw, s, e)
    code, _ = codes(words)
    if ids is not None:
        source = repeated(ids, np.diff(first))
        code, words = code[source], words.take(pa.array(source))
    text, start, length, period = runs(code, first)
    step = np.zeros(len(code) + 1, dtype=np.int64)
    base = first[text] + start
    np.add.at(step, base + period, 1)
    np.add.at(step, base + length, -1)
    kept = np.cumsum(step)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[first]
    left = words.filter(pa.array(kept)) if not kept.all() else words
    lists = pa.LargeListArray.from_arrays(pa.array(ends), left)
    found = np.searchsorted(text, np.arange(len(texts) + 1))
    return {"n_words": np.diff(first), "collapsed": pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())),
            "runs": pa.LargeListArray.from_arrays(pa.array(found), pa.StructArray.from_arrays(
                [pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]))}


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: bool = False) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: all runs by start and period, and the text without what repeats a run's first period.

    With ``repeat`` the texts whose id has a checksum divisible by ten first repeat a part of themselves (a planted test case)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            for lo, hi in pieces(texts, PIECE_BYTES):
                got = _answers(texts[lo:hi], ids[lo:hi] if repeat else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(got["n_words"], pa.int64()), got["runs"].cast(_runs_type()),
                     got["collapsed"].cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(work, f"id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def _runs_type() -> pa.DataType:
    return pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every text of repeats collapsed to one period a run; a null text stays null, a text without runs as it is."""
    names = docs.columns
    at = names.index(text_col)

    def work(batches):
        for b in batches:
            texts, out = as_bytes(b.column(at)), b.column(at).to_pylist()
            for lo, hi in pieces(texts, PIECE_BYTES):
                got = _answers(texts[lo:hi], None)
                n = got["runs"].value_lengths().to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(n):
                    out[lo + k] = got["collapsed"][k].as_py().decode("utf-8")
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(work, docs.schema)


def strongest(found: list) -> dict | None:
    """The run with the most periods; of several the first, then the one of the smallest period."""
    return min(found, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if found else None


def _digests(batches):
    """The reported columns of each row of ``find_runs``."""
    for b in batches:
        rows = b.column(1).to_pylist()
        best = [strongest(r) or {} for r in rows]
        lines = ["".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r) for r in rows]
        cols = [b.column(0), pa.array([len(r) for r in rows], pa.int64())]
        cols += [pa.array([x.get(c) for x in best], pa.int64()) for c in ("start", "length", "period")]
        cols.append(pa.array([1000 * x["length"] // x["period"] if x else None for x in best], pa.int64()))
        cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string()))
        cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in as_bytes(b.column(2))], pa.string()))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_runs(read(spark, sf_dir, "documents"), repeat=True).select("id", "runs", "collapsed")
    return got.mapInArrow(_digests, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
                                    "runs_sha256 string, collapsed_sha256 string")
