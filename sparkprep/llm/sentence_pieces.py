"""SentencePiece encoding and decoding (2): sampled segmentations by forward filtering, backward sampling.

A text is normalised as the model does (one blank in front, blanks kept) and
cut into units: a run of blanks with the characters that follow it.  No piece
runs from one unit into the next, so the lattice of a text is the chain of its
units' lattices, and units that repeat share theirs.  Within a unit, a node is
a character boundary and an edge a piece; the forward filter sums the weights
of all segmentations up to every node, and a segmentation is drawn backwards,
edge by edge, in proportion to its weight.  Random numbers come from a hash of
the row key, the unit's place and the step, so a row's segmentation does not
depend on batches, partitions or retries.

The model ranks its pieces but gives no probabilities, so an edge weighs
``(rank + SHIFT) ** -theta`` by the piece's rank; a larger theta draws
segmentations of fewer, more frequent pieces.  A character without a piece of
its own is spelt in the model's byte pieces.  Decoding joins the pieces' bytes
and drops the blank in front, so it gives back every text exactly, also one
that holds the model's own blank sign.

Defined cases: a null text has null ids, an empty one none; rows that repeat a
key draw the same numbers; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, mix, pieces
from .registry import read, register

SHIFT, THETA = 10.0, 2.0
#: Characters whose units share one lattice; larger pieces take memory and save little time.
PIECE = 1 << 19
_UNIT = re.compile(r" +[^ ]*")
_BASE = U(0xD1B54A32D192ED03)
_models: dict = {}


def _path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _code_points(texts: list) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def _substring_hashes(points: np.ndarray, left: np.ndarray, longest: int):
    """(size, starts, hashes) of the substrings of each size 1 .. longest that the ``left`` characters from a start hold."""
    p, at, h = points.astype(U), np.arange(len(points)), np.zeros(len(points), dtype=U)
    for size in range(1, longest + 1):
        fits = left[at] >= size
        at, h = at[fits], h[fits]
        h = h * _BASE + p[at + (size - 1)]
        yield size, at, mix(h + U(size))


def _units(text: str) -> list:
    """The units of a text with one more blank in front, each without its first blank."""
    parts = text.split(" ")
    return (parts if "" not in parts else [u[1:] for u in _UNIT.findall(" " + text)]) if text else []


class Pieces:
    """The pieces of a model, as tables for the lattice and for decoding."""

    def __init__(self, name: str, theta: float = THETA):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        n = model.get_piece_size()
        self.bytes_of, self.byte_id, normal = [b""] * n, [0] * 256, []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode("utf-8")
                normal.append((i, text, -model.get_score(i)))
        inside = [t for _, t, _ in normal if " " in t.lstrip(" ")]
        if inside:
            raise ValueError(f"pieces run across units: {inside[:3]}")
        self.longest = max(len(t) for _, t, _ in normal)
        self.tables = {}
        for size in range(1, self.longest + 1):
            own = [(i, t, s) for i, t, s in normal if len(t) == size]
            if own:
                left = np.tile(np.arange(size, 0, -1), len(own))
                h = [x for k, _, x in _substring_hashes(_code_points([t for _, t, _ in own]), left, size) if k == size][0]
                order = np.argsort(h)
                ids = np.array([i for i, _, _ in own], dtype=np.int32)[order]
                weight = -theta * np.log(np.array([max(s, 0.0) for _, _, s in own]) + SHIFT)[order]
                bits = np.zeros(1 << 18, dtype=bool)
                bits[(h >> U(46)).astype(np.int64)] = True
                self.tables[size] = (h[order], ids, weight, bits)
        #: A byte piece weighs less than any ranked piece.
        self.byte_weight = -theta * np.log(n + SHIFT)

    def edges(self, units: list):
        """(start node, end node, piece, weight), sorted by position in the unit and end; and each unit's first node."""
        points = _code_points(units)
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        first = np.concatenate([[0], np.cumsum(size)])
        unit = np.repeat(np.arange(len(units)), size)
        left = first[unit + 1] - np.arange(len(points))  # characters up to the unit's end
        out = []
        single = np.zeros(len(points), dtype=bool)
        for k, at, h in _substring_hashes(points, left, self.longest):
            if k not in self.tables:
                continue
            hashes, ids, weight, bits = self.tables[k]
            maybe = bits[(h >> U(46)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            found = np.searchsorted(hashes, h)
            found[found == len(hashes)] = 0
            ok = hashes[found] == h
            at, found = at[ok], found[ok]
            if k == 1:
                single[at] = True
            out.append((at, at + k, ids[found], weight[found]))
        rest = np.flatnonzero(~single)
        if len(rest):
            c = points[rest]
            n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            out.append((rest, rest + 1, np.full(len(rest), -1, np.int32), n_bytes * self.byte_weight))
        a, z, ids, weight = (np.concatenate(x) for x in zip(*out))
        own = unit[a]
        step = z - first[own]
        order = np.lexsort((z, step))
        a, z, own = a[order], z[order], own[order]
        # Nodes of unit u are first[u] + u .. first[u + 1] + u.
        return a + own, z + own, ids[order], weight[order], step[order], first[:-1] + np.arange(len(units)), size

    def lattice(self, units: list):
        """Edges by end node, with running probabilities and each node's first edge: what the backward step draws from."""
        a, z, ids, weight, step, base, size = self.edges(units)
        alpha = np.full(int(base[-1] + size[-1]) + 1, -np.inf)
        alpha[base] = 0.0
        total = np.empty(len(a))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            value, ends = alpha[a[lo:hi]] + weight[lo:hi], z[lo:hi]
            head = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1])
            count = np.diff(np.append(head, hi - lo))
            top = np.maximum.reduceat(value, head)
            p = np.exp(value - np.repeat(top, count))
            s = np.add.reduceat(p, head)
            alpha[ends[head]] = top + np.log(s)
            total[lo:hi] = p / np.repeat(s, count)
        head = np.concatenate([[0], np.flatnonzero(z[1:] != z[:-1]) + 1])
        before = np.concatenate([[0.0], np.cumsum(total)])
        run = before[1:] - np.repeat(before[head], np.diff(np.append(head, len(z))))
        run[np.append(head[1:], len(z)) - 1] = 2.0  # the last edge of a node takes what rounding leaves
        lead = np.full(len(alpha), -1, dtype=np.int64)
        lead[z[head]] = head
        return a, ids, run, lead, base, base + size

    def sample(self, texts: list, keys: np.ndarray) -> list:
        """Piece ids of each text, drawn with the numbers of its key."""
        cut = [_units(t) for t in texts]
        count = np.array([len(c) for c in cut], dtype=np.int64)
        flat = [u for c in cut for u in c]
        if not flat:
            return [np.empty(0, np.int32) for _ in texts]
        number = {u: i for i, u in enumerate(dict.fromkeys(flat))}
        which = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        a, ids, run, lead, bottom, top = self.lattice([" " + u for u in number])
        own = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        seed = mix(keys[own] + place.astype(U) * U(0x9E3779B97F4A7C15))
        active, node, step, got = np.arange(len(which)), top[which], 0, []
        length = np.zeros(len(which), dtype=np.int64)
        while len(active):
            u = (mix(seed[active] + U(step * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(np.float64) * 2.0 ** -53
            e = lead[node]
            late = np.flatnonzero(run[e] <= u)
            while len(late):
                e[late] += 1
                late = late[run[e[late]] <= u[late]]
            got.append((active, e))
            length[active] += 1
            node, step = a[e], step + 1
            more = node > bottom[which[active]]
            active, node = active[more], node[more]
        finish = np.cumsum(length)
        edge, occurrence = np.empty(int(finish[-1]), dtype=np.int64), np.repeat(np.arange(len(which)), length)
        for step, (rows, e) in enumerate(got):
            edge[finish[rows] - 1 - step] = e
        piece, start = ids[edge], a[edge]
        ends = np.concatenate([[0], finish])[np.concatenate([[0], np.cumsum(count)])]
        out, units = [], [" " + u for u in number]
        for lo, hi in zip(ends[:-1], ends[1:]):
            p = piece[lo:hi]
            if len(p) and p.min() < 0:  # byte pieces in the place of characters without a piece
                spelt = []
                for x, o, s in zip(p.tolist(), occurrence[lo:hi].tolist(), start[lo:hi].tolist()):
                    u = which[o]
                    spelt += [x] if x >= 0 else [self.byte_id[y] for y in units[u][s - bottom[u]].encode("utf-8")]
                p = np.array(spelt, dtype=np.int32)
            out.append(p)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")[1:]


def model(name: str, theta: float = THETA) -> Pieces:
    if (name, theta) not in _models:
        _models[name, theta] = Pieces(name, theta)
    return _models[name, theta]


def encode(docs: DataFrame, name: str, key_col: str = "doc_id", text_col: str = "text", theta: float = THETA, seed: int = 0,
           keep: list | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``ids``, the sampled piece ids of each text, and ``lossless``, whether they decode to it.

    The ids are the same for the same key, seed and theta."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "lossless")]
    plain = docs.select(*dict.fromkeys([*kept, text_col])).withColumn("__key", F.xxhash64(docs[key_col], F.lit(seed)))

    def run(batches):
        m = model(name, theta)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            keys = b.column("__key").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            parts, sizes, same = [np.empty(0, np.int32)], [0], []
            filled = ["" if t is None else t for t in texts]
            for lo, hi in pieces(filled, PIECE):
                drawn = m.sample(filled[lo:hi], keys[lo:hi])
                sizes += [len(p) for p in drawn]
                same += [None if t is None else m.decode(p.tolist()) == t for t, p in zip(texts[lo:hi], drawn)]
                parts.append(np.concatenate(drawn))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts), pa.int32()),
                                           mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], ids, pa.array(same, pa.bool_())], [*kept, "ids", "lossless"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return plain.mapInArrow(run, f"{fields}ids array<int>, lossless boolean")


def decode(encoded: DataFrame, name: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids; null stays null, no ids give the empty text."""
    kept = [c for c in encoded.columns if c != out_col]

    def run(batches):
        m = model(name)
        for b in batches:
            texts = [m.decode(x.as_py()) if x.is_valid else None for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != out_col)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` string")


def encoded_and_checked(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of every row."""
    got = encode(docs, name, keep=["doc_id"])
    return got.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "lossless")


@register("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str, name: str = "piece_bpe_32k.model") -> DataFrame:
    return encoded_and_checked(read(spark, sf_dir, "documents"), name)
