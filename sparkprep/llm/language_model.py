"""LM scoring (4): an Elias-Fano n-gram trie over the whole training corpus, kept as tables and applied to any documents.

The model is a trigram model by interpolated absolute discounting (discount
``D``) down to add-one unigrams,

    p3(w | x2 x1) = max(c(x2 x1 w) - D, 0) / c(x2 x1) + D t(x2 x1) / c(x2 x1) p2(w | x1),
    p2(w | x1)    = max(c(x1 w) - D, 0) / c(x1) + D t(x1) / c(x1) p1(w),   p1(w) = (c(w) + 1) / (N + V + 1),

with t the number of different words seen after a context; a context never
seen leaves the answer to the shorter one.

* **Pieces.**  Texts become token numbers into their piece's own words, written
  once with the ids and sizes of their texts, so every later step reads the
  same rows in the same order.
* **Words** are counted in buckets of a hash and get ids there; each piece asks
  every bucket once for its words.  Only this exchange carries word hashes.
* **Shards.**  Tokens are dealt by their predecessor x1, as sorted id columns
  and numbers into a short list of the row's words: all that p2 and p3 need of a
  context lies in one shard.  Their number follows the training tokens.  A word
  with more than a quarter of a shard is hot: its bigrams are counted like
  words, in buckets of their own, so that pieces know them, and its tokens are
  dealt by (x1, x2).
* **Trie.**  A shard holds monotone Elias-Fano sequences: its word ids; the
  words after each word; the words before each word (the contexts); and after
  each context the words that follow, numbered relative to the words after x1.
  A node is found by successor search, which also gives the first child of a
  parent.  Smoothed probabilities and the weights of shorter contexts are
  quantised to 8 bits, in equally filled bins.  Levels are one file, memory-mapped for the queries.

``train`` writes a model, ``score`` applies it to any table, ``train_and_score``
does both for one table and deals its tokens once (the query does that and
keeps no model).  Counts cover every training
text and nothing is pruned.  Words are known by 64-bit hashes (after a hot word
by 48 bits of them); a text is one unit of its piece.

Defined cases: a null or empty text is one end token; a text with a null id is
not learnt from; rows that repeat an id are scored one by one; an empty table
gives an empty result; without training texts every count is 0 and every token
has probability 1.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._fs import scratch_dir
from .elias_fano import EliasFano, map_levels, write_levels
from .kernels import U, VISIBLE, Words, as_bytes, mix, per_text, pieces
from .registry import read, register
from .sampling import held_out

D = 0.8

#: Hashes of the end token and of the place before a text; no word has them.
END, START = U(0x0E4D0E4D0E4D0E4D), U(0x57A7757A7757A775)
#: Bytes of a piece, training tokens of a shard, scored tokens of a shard at a time, and keys of a counting bucket.
PIECE, SHARD, TURN, BUCKET = 12 << 20, 1_600_000, 2_000_000, 2_000_000
#: Hot words at most (a pair of one and another word is 16 and 48 bits).
HOT = 1 << 16


def _z(a: np.ndarray, delta: bool = False) -> bytes:
    """Unsigned integers by byte planes, compressed; ``delta`` for ascending ones."""
    a = np.asarray(a, dtype=U)
    if delta and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    wide = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return bytes([wide, delta]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T[:wide]).tobytes())


def _un(z: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z[2:]), dtype=np.uint8).reshape(z[0], -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :z[0]] = raw.T
    a = out.view(U).ravel()
    return np.cumsum(a, dtype=U) if z[1] else a


def _row(fields: str, *values) -> pa.RecordBatch:
    """One row of a schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    spec = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, spec)], [n for n, _ in spec])


def _table(fields: str, rows: list) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    spec = [f.split() for f in fields.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [()] * len(spec), spec)], names=[n for n, _ in spec])


def _keep(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, mark) -> DataFrame:
    """One row per piece of texts: its ids and marks, tokens of each text, hashes of its words and tokens as numbers into them.

    Words stand by falling frequency, the place before a text last, so that numbers are small."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces(texts, PIECE):
                w = Words(texts[lo:hi], VISIBLE)
                words, number, n = np.unique(np.insert(w.hash, w.first[1:], END), return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                cols = [pa.array([(part << 32) | made], pa.int64()),
                        pa.array([b.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(b.schema.field(0).type)),
                        pa.array([b.column(2).slice(lo, hi - lo).to_pylist()], pa.list_(pa.bool_())),
                        pa.array([_z(w.count + 1)], pa.binary()), pa.array([_z(np.append(words[order], START))], pa.binary()),
                        pa.array([_z(place[number])], pa.binary()), pa.array([len(words) + 1], pa.int64()), pa.array([len(number)], pa.int64())]
                made += 1
                yield pa.RecordBatch.from_arrays(cols, ["piece", "ids", "marks", "sizes", "words", "tokens", "n_words", "n_tokens"])

    plain = docs.select(F.col(id_col), F.col(text_col).cast("string"), F.coalesce(mark, F.lit(False)).alias("mark"))
    return _keep(plain.mapInArrow(run, f"piece bigint, ids array<{kind}>, marks array<boolean>, sizes binary, words binary, tokens binary, "
                                       "n_words bigint, n_tokens bigint"), path)


_ASK = "kind int, bucket int, piece bigint, keys binary, counts binary"
#: The counts of a bucket (piece -1): keys and counts; or an answer: places in the bucket by falling count, from 1 (0: unknown), and counts.
_TOLD = "kind int, bucket int, piece bigint, keys binary, counts binary, n bigint, distinct bigint"


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by bucket, where each bucket begins and the last ends); the order is the same wherever it is computed."""
    at = (mix(keys) % U(buckets)).astype(np.int64)
    order = np.lexsort((keys, at))
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def _answers(kind, bucket, table: tuple, asks: list) -> list:
    keys, counts = table
    rank, out = _ranks(counts), []
    for piece, own in asks:
        at = np.searchsorted(keys, own)
        there = at < len(keys)
        there[there] = keys[at[there]] == own[there]
        at = np.where(there, at, 0)
        out.append((kind, bucket, piece, _z(np.where(there, rank[at] + 1 if len(keys) else 0, 0)),
                    _z(np.where(there, counts[at] if len(keys) else 0, 0)), None, None))
    return out


def _ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each key of a bucket by falling count; over all buckets ids then fall with the count, nearly."""
    out = np.empty(len(counts), np.int64)
    out[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(counts))
    return out


def _count_and_answer(asks: DataFrame, path: str) -> DataFrame:
    """The sums of all keys of each bucket, ascending and above 0, and the answers to every piece that asked."""
    def run(t: pa.Table) -> pa.Table:
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        own = [_un(k) for k in t.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([_un(c) for c in t.column("counts").to_pylist()]).astype(np.float64)).astype(np.int64)
        del at
        keys, n = keys[n > 0], n[n > 0]
        rows = [(kind, bucket, -1, _z(keys, True), _z(n), int(n.sum()), len(n))]
        return _table(_TOLD, rows + _answers(kind, bucket, (keys, n), zip(t.column("piece").to_pylist(), own)))

    return _keep(asks.groupBy("kind", "bucket").applyInArrow(run, _TOLD), path)


def _look_up_counts(table: DataFrame, asks: DataFrame, turns: int, path: str) -> DataFrame:
    """Answers from counts that an earlier run wrote; the asks of a bucket go in turns, so that a task holds a bounded number."""
    def run(t: pa.Table, a: pa.Table) -> pa.Table:
        if not a.num_rows:
            return _table(_TOLD, [])
        known = tuple(_un(t.column(c)[0].as_py()) for c in ("keys", "counts")) if t.num_rows else (np.empty(0, U), np.empty(0, U))
        kind, bucket = a.column("kind")[0].as_py(), a.column("bucket")[0].as_py()
        return _table(_TOLD, _answers(kind, bucket, known, ((p, _un(k)) for p, k in zip(a.column("piece").to_pylist(), a.column("keys").to_pylist()))))

    left = table.where("piece = -1").select("kind", "bucket", "keys", "counts").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asks.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(turns)).cast("int"))
    return _keep(left.groupBy("kind", "bucket", "g").cogroup(right.groupBy("kind", "bucket", "g")).applyInArrow(run, _TOLD), path)


class Model:
    """Counts and tries as tables in ``path``: words, hot (pairs after hot words), hot_words and tries."""

    ABOUT = "shards int, buckets int, hot_buckets int, total bigint, vocabulary bigint"
    HOT = "hash bigint, id bigint, n bigint, followers bigint"
    TRIES = "shard int, piece bigint, levels binary, texts binary, sums binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.about = spark.read.schema(self.ABOUT).parquet(f"{path}/about").first().asDict()
        rows = spark.read.schema(self.HOT).parquet(f"{path}/hot_words").collect()  # at most 4 * shards
        hot = sorted((int(np.int64(r[0]).view(U)), *r[1:]) for r in rows)
        self.about |= {"hot_hash": np.array([r[0] for r in hot], dtype=U)} | {
            k: np.array([r[i] for r in hot], dtype=np.int64) for i, k in ((1, "hot_id"), (2, "hot_n"), (3, "hot_t"))}

    def table(self, name: str, fields: str = _TOLD) -> DataFrame:
        return self.spark.read.schema(fields).parquet(f"{self.path}/{name}")


class _Piece:
    """A piece and, with answers, the ids and counts of its words; id 0 is unknown."""

    def __init__(self, row: dict, told: list | None = None, about: dict | None = None):
        self.sizes = _un(row["sizes"]).astype(np.int64)
        self.words, self.w = _un(row["words"]), _un(row["tokens"]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        if told is None:
            return
        self.ids, self.counts = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        order, ends = _split(self.words, about["buckets"])
        for a in told:
            if a["kind"] == 0:
                some, place = order[ends[a["bucket"]]:ends[a["bucket"] + 1]], _un(a["keys"]).astype(np.int64)
                self.ids[some] = np.where(place > 0, place * about["buckets"] + a["bucket"], 0)
                self.counts[some] = _un(a["counts"])

    def history(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token, and the one before that."""
        x1, x2 = np.empty_like(self.w), np.empty_like(self.w)
        x1[1:], x2[2:] = self.w[:-1], self.w[:-2]
        x1[self.first[:-1]] = x2[self.first[:-1]] = len(self.words) - 1
        second = self.first[:-1] + 1
        x2[second[self.sizes > 1]] = len(self.words) - 1
        return x1, x2

    def hot_pairs(self, hot: np.ndarray) -> tuple:
        """(tokens after a hot word, the hot word's number, the pair's number, keys of the pairs)."""
        at = np.minimum(np.searchsorted(hot, self.words), max(len(hot) - 1, 0))
        number = np.where(hot[at] == self.words, at, -1) if len(hot) else np.full(len(self.words), -1)
        x1, _ = self.history()
        after = np.flatnonzero(number[x1] >= 0)
        which = number[x1[after]]
        keys, pair = np.unique(which.astype(U) << U(48) | self.words[self.w[after]] & U((1 << 48) - 1), return_inverse=True)
        return after, which, pair, keys


def _word_asks(own: DataFrame, buckets: int, learn: bool) -> DataFrame:
    """The words of each piece by bucket, with the number of their tokens in marked texts when learning."""
    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                p, n = _Piece(r), None
                if learn:
                    marks = np.array(r["marks"], dtype=bool)
                    n = np.bincount(p.w[np.repeat(marks, p.sizes)], minlength=len(p.words))
                    n[-1] = marks.sum()
                yield from _asks(0, r["piece"], p.words, n, buckets)

    return own.select("piece", "marks", "sizes", "words", "tokens").mapInArrow(ask, _ASK)


def _asks(kind: int, piece: int, keys: np.ndarray, counts, buckets: int):
    order, ends = _split(keys, buckets)
    for b in np.flatnonzero(np.diff(ends)):
        some = order[ends[b]:ends[b + 1]]
        yield _row(_ASK, kind, int(b), piece, _z(keys[some], True), b"" if counts is None else _z(counts[some]))


def _hot_asks(own: DataFrame, hot: np.ndarray, buckets: int, learn: bool) -> DataFrame:
    shared = own.sparkSession.sparkContext.broadcast(hot)

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                p, n = _Piece(r), None
                after, _, pair, keys = p.hot_pairs(shared.value)
                if learn:
                    marked = np.repeat(np.array(r["marks"], dtype=bool), p.sizes)[after]
                    n = np.bincount(pair[marked], minlength=len(keys))
                yield from _asks(1, r["piece"], keys, n, buckets)

    return own.select("piece", "marks", "sizes", "words", "tokens").mapInArrow(ask, _ASK)


def _steps(x1: np.ndarray, w: np.ndarray, x2: np.ndarray) -> tuple[bytes, bytes]:
    """w and x2 in the order of (x1, w, x2), as steps from the row before where x1 (and w) are the same."""
    same1 = np.concatenate([[False], x1[1:] == x1[:-1]])
    same2 = same1 & np.concatenate([[False], w[1:] == w[:-1]])
    return tuple(_z(np.where(same, x - np.concatenate([[0], x[:-1]]), x)) for x, same in ((w, same1), (x2, same2)))


def _unstep(x1: np.ndarray, w: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def whole(steps, same):
        total = np.cumsum(steps.astype(np.int64))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(steps))))
        return total - total[first] + steps[first].astype(np.int64)

    same = np.concatenate([[False], x1[1:] == x1[:-1]])
    w = whole(w, same)
    return w, whole(x2, same & np.concatenate([[False], w[1:] == w[:-1]]))


_DEALT = ("shard int, turn int, piece bigint, x1 binary, names binary, counts binary, w binary, x2 binary, hot binary, pair binary, "
          "texts binary, marks binary, n bigint")


def _dealt(own: DataFrame, told: DataFrame, about: dict, turns: int) -> DataFrame:
    """The tokens of each piece by shard, in the order of (x1, w, x2); w and x2 number the row's words, which stand by id.

    After a hot word ``hot`` is its number from 1 and ``pair`` the training count of the pair.  A row of no tokens holds the base scores
    (``hot``) and the known tokens (``pair``) of the texts of its piece."""
    shared = own.sparkSession.sparkContext.broadcast(about)

    def deal(pieces_: pa.Table, told: pa.Table) -> pa.Table:
        m, rows = shared.value, []
        told = told.to_pylist()
        for row in pieces_.to_pylist():
            p = _Piece(row, told, m)
            x1, x2 = p.history()
            after, which, pair, keys = p.hot_pairs(m["hot_hash"])
            hot, count2 = np.zeros(len(p.w), np.int64), np.zeros(len(p.w), np.int64)
            if len(keys):
                order, ends = _split(keys, m["hot_buckets"])
                c2 = np.zeros(len(keys), np.int64)
                for a in told:
                    if a["kind"] == 1:
                        c2[order[ends[a["bucket"]]:ends[a["bucket"] + 1]]] = _un(a["counts"])
                hot[after], count2[after] = which + 1, c2[pair]
            a, w, b = p.ids[x1], p.ids[p.w], p.ids[x2]
            shard = (mix(np.where(hot > 0, a.astype(U) ^ mix(b.astype(U)), a.astype(U))) % U(m["shards"])).astype(np.int64)
            text = np.repeat(np.arange(len(p.sizes)), p.sizes)
            rank, wide, by_id = np.unique(p.ids, return_inverse=True)[1].astype(U), U(len(p.words)), np.empty(len(p.words), U)
            by_id[np.argsort(p.ids, kind="stable")] = np.arange(len(p.words))
            order = np.argsort((rank[x1] * wide + by_id[p.w]) * wide + by_id[x2])
            order = order[np.argsort(shard[order].astype(np.int16 if m["shards"] < 1 << 15 else np.int32), kind="stable")]
            ends = np.searchsorted(shard[order], np.arange(m["shards"] + 1))
            turn = int(mix(np.array([row["piece"]], dtype=np.int64).view(U))[0] % U(turns))
            marks = np.packbits(np.array(row["marks"], dtype=bool)).tobytes()
            # what needs no context is summed here, and goes along with the tokens of any shard
            known = per_text((p.counts[p.w] > 0).astype(np.int64), p.first)
            base = per_text(np.log10(p.counts[p.w] + 1.0), p.first) - p.sizes * np.log10(m["total"] + m["vocabulary"] + 1)
            rows.append((int(U(row["piece"] & (1 << 62) - 1) % U(m["shards"])), turn, row["piece"], *[b""] * 5, base.tobytes(), _z(known), b"", b"", 0))
            lut = np.zeros(len(p.words), np.int64)
            for s in np.flatnonzero(np.diff(ends)):
                z = order[ends[s]:ends[s + 1]]
                used = np.unique(np.concatenate([p.w[z], x2[z]]))
                used = used[np.argsort(p.ids[used], kind="stable")]
                lut[used] = np.arange(len(used))
                some = hot[z].any()
                rows.append((int(s), turn, row["piece"], _z(a[z], True), _z(p.ids[used], True), _z(p.counts[used]), *_steps(a[z], lut[p.w[z]], lut[x2[z]]),
                             _z(hot[z]) if some else b"", _z(count2[z]) if some else b"", _z(text[z]), marks, len(z)))
        return _table(_DEALT, rows)

    return own.drop("ids").groupBy("piece").cogroup(told.where("piece >= 0").groupBy("piece")).applyInArrow(deal, _DEALT)


class _Tokens:
    """The tokens of one shard.

    ``ids`` ascending, and by id the count; ``pair`` (x1, w), ``context`` (x1, x2) and ``tri`` (context, pair) are the distinct n-grams
    as numbers, ``pair_of``, ``context_of`` and ``tri_of`` those of each token; ``lower`` is p1, or p2 after a hot word, of each pair."""

    def __init__(self, rows: pa.Table, m: dict):
        def column(name):
            return [_un(z) if z else None for z in rows.column(name).to_pylist()]

        self.n = rows.column("n").to_pylist()
        names, counts, firsts, ws, x2s = column("names"), column("counts"), [], [], []
        for z, w, x2 in zip(column("x1"), column("w"), column("x2")):
            new = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
            firsts.append((z[new], np.diff(np.append(new, len(z)))))
            for out, x in zip((ws, x2s), _unstep(z, w, x2)):
                out.append(x.astype(np.int32))
        self.ids, number = np.unique(np.concatenate([*names, *[f for f, _ in firsts]]), return_inverse=True)
        number, cut = number.astype(np.int32), np.cumsum([len(x) for x in (*names, *[f for f, _ in firsts])])[:-1]
        number = np.split(number, cut)
        self.count = np.zeros(len(self.ids), np.int64)
        for k, c in zip(number, counts):
            self.count[k] = c
        wide = U(len(self.ids))
        a = np.concatenate([np.repeat(k, n) for k, (_, n) in zip(number[len(names):], firsts)])
        c = np.concatenate([k[x] for k, x in zip(number, x2s)])
        self.context, self.context_of = _distinct(a.astype(U) * wide + c.astype(U))
        del c
        b = np.concatenate([k[x] for k, x in zip(number, ws)])
        self.pair, self.pair_of = _distinct(a.astype(U) * wide + b.astype(U))
        self.w = b
        self.tri, self.tri_of = _distinct(self.context_of.astype(U) * U(len(self.pair)) + self.pair_of.astype(U))
        self.text = np.concatenate([x.astype(np.int32) for x in column("texts")])
        at, marks = 0, []
        for bits, n in zip(rows.column("marks").to_pylist(), self.n):
            marks.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)[self.text[at:at + n]])
            at += n
        self.mark = np.concatenate(marks)
        self.p1 = (self.count + 1.0) / (m["total"] + m["vocabulary"] + 1)
        self.lower = self.p1[(self.pair % wide).astype(np.int64)]
        at = 0
        for hot, pair, n in zip(column("hot"), column("pair"), self.n):
            if hot is not None:
                some = np.flatnonzero(hot)
                which, count = hot[some].astype(np.int64) - 1, pair[some].astype(np.int64)
                total, followers = m["hot_n"][which], m["hot_t"][which]
                self.lower[self.pair_of[at + some]] = np.maximum(count - D, 0) / total + D * followers / total * self.p1[self.w[at + some]]
            at += n

    def sums(self, log: np.ndarray, pieces_: list):
        """(piece, texts, sums as float32) of each row, given log10 p3 of each distinct trigram."""
        at = 0
        for piece, n in zip(pieces_, self.n):
            z = slice(at, at + n)
            u, back = np.unique(self.text[z], return_inverse=True)
            yield piece, _z(u, True), _zf(np.bincount(back, weights=log[self.tri_of[z]]))
            at += n


def _zf(x: np.ndarray) -> bytes:
    """Floats of 32 bits, by byte planes, compressed."""
    return _z(x.astype(np.float32).view(np.uint32))


def _unf(z: bytes) -> np.ndarray:
    return _un(z).astype(np.uint32).view(np.float32).astype(np.float64)


def _answer(rows: pa.Table, m: dict, tries: pa.Table | None, keep: bool) -> pa.Table:
    """The sums of the texts of each piece in one shard; the trie is read from ``tries``, or built and, if asked, kept."""
    no, out = rows.column("shard")[0].as_py(), []
    for r in rows.filter(pc.equal(rows.column("n"), 0)).select(["piece", "hot", "pair"]).to_pylist():
        out.append((no, r["piece"], None, None, r["hot"] + _un(r["pair"]).astype(np.int64).tobytes()))
    rows = rows.filter(pc.greater(rows.column("n"), 0))
    if rows.num_rows:
        t = _Tokens(rows, m)
        if tries is None or tries.num_rows:
            data, log = _levels(t, m, None if tries is None else tries.column("levels")[0].as_py(), tries is None)
            out += [(no, -1, data, None, None)] * keep
        else:  # nothing was learnt here
            log = np.log10(t.lower)[(t.tri % U(len(t.pair))).astype(np.int64)]
        out += [(no, p, None, u, v) for p, u, v in t.sums(log, rows.column("piece").to_pylist())]
    return _table(Model.TRIES, out)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, number of each element among them as int32)."""
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(key) else np.empty(0, bool)
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(new) - 1
    return sorted_[new], out


def _quantised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit codes of log10 p, the values of the codes): equally filled bins of the values, each stored as its mean."""
    x = np.log10(p)
    if len(x) <= 256:
        values, code = np.unique(x, return_inverse=True)
        return code.astype(np.uint8), np.concatenate([values, np.zeros(1)])[:max(1, len(values))]
    some = np.sort(x[::max(1, len(x) // 65536)])
    edges = np.unique(some[np.arange(1, 256) * len(some) // 256])
    code = np.searchsorted(edges, x, side="right")
    n = np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), np.bincount(code, weights=x, minlength=len(n)) / np.maximum(n, 1)


class Trie:
    """One shard of the model: levels mapped from a file."""

    def __init__(self, path: str):
        self.seq, self.arr = map_levels(path)
        self.width, self.ranks = (U(int(v)) for v in self.arr["width"])

    @staticmethod
    def build(path: str, t: _Tokens, hot: np.ndarray) -> None:
        """Write the levels of the marked tokens of a shard."""
        wide = len(t.ids)
        c2, cc, c3 = (np.bincount(of[t.mark], minlength=len(g)) for of, g in ((t.pair_of, t.pair), (t.context_of, t.context), (t.tri_of, t.tri)))
        pair, context, tri = (np.flatnonzero(c) for c in (c2, cc, c3))
        c2, cc, c3 = c2[pair], cc[context], c3[tri]
        split = lambda keys, n: ((keys // U(n)).astype(np.int64), (keys % U(n)).astype(np.int64))
        (a, b), (_, c) = split(t.pair[pair], wide), split(t.context[context], wide)
        ca = (t.context[context] // U(wide)).astype(np.int64)
        used = np.zeros(wide, dtype=bool)
        used[a] = used[b] = used[c] = True
        ids, place = t.ids[used], np.cumsum(used) - 1
        width = U(max(len(ids), 1))
        parent = place[a]
        two, before = parent.astype(U) * width + place[b].astype(U), place[ca].astype(U) * width + place[c].astype(U)
        begin = np.searchsorted(parent, np.arange(len(ids)))
        c1 = np.bincount(parent, weights=c2, minlength=len(ids))
        followers = np.bincount(parent, minlength=len(ids))
        is_hot = np.isin(ids, hot)
        weight1 = np.where(is_hot | (c1 == 0), 1.0, D * followers / np.maximum(c1, 1))
        lower = t.lower[pair]
        p2 = np.where(is_hot[parent], lower, np.maximum(c2 - D, 0) / np.maximum(c1[parent], 1) + weight1[parent] * lower)
        up, bi = split(t.tri[tri], len(t.pair))
        up, bi = np.searchsorted(context, up), np.searchsorted(pair, bi)
        weight2 = D * np.bincount(up, minlength=len(context)) / np.maximum(cc, 1)
        p3 = np.maximum(c3 - D, 0) / np.maximum(cc[up], 1) + weight2[up] * p2[bi]
        rank = bi - begin[parent[bi]]
        ranks = U(int(rank.max()) + 1 if len(rank) else 1)
        arrays = {"width": np.array([int(width), int(ranks)], dtype=np.int64)}
        for name, p in (("l1", weight1), ("p2", p2), ("l2", weight2), ("p3", p3)):
            arrays[name], arrays[f"{name}s"] = _quantised(p)
        write_levels(path, {"ids": EliasFano.build(ids), "two": EliasFano.build(two), "context": EliasFano.build(before),
                            "three": EliasFano.build(up.astype(U) * ranks + rank.astype(U))}, arrays)

    def _log(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.arr[f"{name}s"][self.arr[name][at]]

    def _find(self, level: str, known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, whether there is one) for each key; keys that are not known are not searched."""
        at, there = np.zeros(len(key), np.int64), known.copy()
        some = np.flatnonzero(known)
        at[some], there[some] = self.seq[level].successor(key[some])
        at[~there] = 0
        return at, there

    def log10(self, t: _Tokens) -> np.ndarray:
        """log10 p3 of each distinct trigram of a shard's tokens."""
        wide, out = U(len(t.ids)), np.log10(t.lower)
        place, is_id = self.seq["ids"].successor(t.ids)
        place[~is_id] = 0
        place = place.astype(U)
        a, b = ((t.pair // wide).astype(np.int64), (t.pair % wide).astype(np.int64))
        two, is_two = self._find("two", is_id[a] & is_id[b], place[a] * self.width + place[b])
        if self.seq["two"].n:
            out = np.where(is_two, self._log("p2", two), np.where(is_id[a], self._log("l1", place[a].astype(np.int64)), 0) + out)
        ca, c = ((t.context // wide).astype(np.int64), (t.context % wide).astype(np.int64))
        context, is_context = self._find("context", is_id[ca] & is_id[c], place[ca] * self.width + place[c])
        up, bi = (t.tri // U(len(t.pair))).astype(np.int64), (t.tri % U(len(t.pair))).astype(np.int64)
        heads = np.flatnonzero(is_id)  # the first word after each word has the number 0
        begin = np.zeros(len(t.ids), np.int64)
        begin[heads] = self.seq["two"].successor(place[heads] * self.width)[0]
        key = context[up].astype(U) * self.ranks + np.where(is_two[bi], two[bi] - begin[a[bi]], 0).astype(U)
        three, is_three = self._find("three", is_context[up] & is_two[bi], key)
        out = out[bi]
        if self.seq["three"].n:
            out = np.where(is_three, self._log("p3", three), out + np.where(is_context[up], self._log("l2", context[up]), 0))
        return out


def _levels(t: _Tokens, m: dict, data: bytes | None, learn: bool) -> tuple[bytes | None, np.ndarray]:
    """(the trie of a shard, log10 p3 of its trigrams): built from the marked tokens, or read from ``data``."""
    folder = tempfile.mkdtemp()
    try:
        path = f"{folder}/levels"
        if learn:
            Trie.build(path, t, m["hot_id"].astype(U))
        else:
            with open(path, "wb") as f:
                f.write(data)
        log = Trie(path).log10(t)
        if learn:
            with open(path, "rb") as f:
                data = f.read()
        return data, log
    finally:
        if os.path.exists(f"{folder}/levels"):
            os.unlink(f"{folder}/levels")
        os.rmdir(folder)


def _learn(docs: DataFrame, mark, path: str | None, id_col: str, text_col: str, shard: int, bucket: int, keep: bool) -> tuple:
    """(model, pieces, sums of every text by shard); the model is learnt from the marked rows, its tries are written if they are to be kept."""
    spark, store = docs.sparkSession, scratch_dir(docs.sparkSession, "lm")
    path = path or f"{store}/model"
    own = tokenised(docs, f"{store}/pieces", id_col, text_col, mark & F.col(id_col).isNotNull())
    n_words, n_tokens = (v or 0 for v in own.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    about = {"buckets": -(-n_words // bucket) or 1, "shards": -(-n_tokens // shard) or 1, "hot_buckets": 1}
    words = _count_and_answer(_word_asks(own, about["buckets"], True), f"{path}/words")
    counts = words.where("piece = -1")
    every, distinct = (v or 0 for v in counts.agg(F.sum("n"), F.sum("distinct")).first())
    texts = own.select(F.explode("marks").alias("m")).where("m").count()
    about |= {"total": every - texts, "vocabulary": max(distinct - 1, 0)}
    least, buckets = max(shard // 4, about["total"] // HOT), about["buckets"]

    def frequent(batches):
        for b in batches:
            for r in b.to_pylist():
                keys, n = _un(r["keys"]), _un(r["counts"]).astype(np.int64)
                at = np.flatnonzero((n > least) & (keys != END))  # the end token is no context
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array((_ranks(n)[at] + 1) * buckets + r["bucket"]), pa.array(n[at])],
                                                 ["hash", "id", "n"])

    hot = counts.select("bucket", "keys", "counts").mapInArrow(frequent, "hash bigint, id bigint, n bigint").collect()
    hot = sorted((int(np.int64(r[0]).view(U)), r[1], r[2]) for r in hot)
    followers, told = [0] * len(hot), words
    if hot:
        about["hot_buckets"] = -(-sum(h[2] for h in hot) // bucket) or 1
        names = np.array([h[0] for h in hot], dtype=U)
        pairs = _count_and_answer(_hot_asks(own, names, about["hot_buckets"], True), f"{path}/hot")

        def after(batches):
            for b in batches:
                for r in b.to_pylist():
                    u, k = np.unique((_un(r["keys"]) >> U(48)).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(k)], ["i", "k"])

        got = dict(map(tuple, pairs.where("piece = -1").select("keys").mapInArrow(after, "i bigint, k bigint").groupBy("i").agg(F.sum("k")).collect()))
        followers, told = [got.get(i, 0) for i in range(len(hot))], words.unionByName(pairs)
    one = [(about[k] for k in ("shards", "buckets", "hot_buckets", "total", "vocabulary"))]
    spark.createDataFrame([tuple(r) for r in one], Model.ABOUT).coalesce(1).write.parquet(f"{path}/about")
    rows = [(int(np.uint64(h[0]).view(np.int64)), h[1], h[2], t) for h, t in zip(hot, followers)]
    spark.createDataFrame(rows, Model.HOT).coalesce(1).write.parquet(f"{path}/hot_words")
    model = Model(spark, path)
    shared = spark.sparkContext.broadcast(model.about)

    def build(rows: pa.Table) -> pa.Table:
        return _answer(rows, shared.value, None, keep)

    found = _keep(_dealt(own, told, model.about, 1).groupBy("shard").applyInArrow(build, Model.TRIES), f"{path}/tries")
    return model, own, found.where("piece >= 0")


def _scores(own: DataFrame, found: DataFrame, total: int, id_kind: str) -> DataFrame:
    def gather(pieces_: pa.Table, parts: pa.Table) -> pa.Table:
        kinds = [pieces_.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names, tables = ["id", "mark", "n_tokens", "n_known", "train_tokens", "base_score", "score"], []
        told = sorted(parts.to_pylist(), key=lambda t: t["shard"])
        for row in pieces_.to_pylist():
            sizes = _un(row["sizes"]).astype(np.int64)
            n, log, base, known = len(sizes), np.zeros(len(sizes)), None, None
            for t in told:
                if t["texts"] is None:
                    base, known = np.frombuffer(t["sums"], np.float64, n), np.frombuffer(t["sums"], np.int64, n, 8 * n)
                else:
                    log[_un(t["texts"]).astype(np.int64)] += _unf(t["sums"])
            cols = [row["ids"], row["marks"], sizes, known, np.full(n, total), base, log]
            tables.append(pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names))
        return pa.concat_tables(tables or [pa.table([pa.array([], k) for k in kinds], names=names)])

    return own.select("piece", "ids", "marks", "sizes").groupBy("piece").cogroup(found.select("shard", "piece", "texts", "sums").groupBy("piece")).applyInArrow(
        gather, f"id {id_kind}, mark boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int | None = None,
          bucket: int | None = None) -> Model:
    """Learn from all rows of ``docs`` with an id; the model is written to ``path`` (a scratch folder by default)."""
    return _learn(docs, F.lit(True), path, id_col, text_col, shard or SHARD, bucket or BUCKET, True)[0]


def train_and_score(docs: DataFrame, mark, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """(model learnt from the rows where ``mark`` is true, ``score`` of all rows).

    Without a ``path`` each trie lives in its task only, from the last token learnt to the last one scored, and there is no model to return."""
    model, own, found = _learn(docs, mark, path, id_col, text_col, SHARD, BUCKET, path is not None)
    return model if path else None, _scores(own, found, model.about["total"], docs.schema[id_col].dataType.simpleString())


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark=None) -> DataFrame:
    """(id, mark, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; ``mark`` is a boolean column to pass on."""
    store, m = scratch_dir(docs.sparkSession, "lm-score"), model.about
    own = tokenised(docs, f"{store}/pieces", id_col, text_col, F.lit(False) if mark is None else mark)
    n_words, n_tokens = (v or 0 for v in own.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    told = _look_up_counts(model.table("words"), _word_asks(own, m["buckets"], False), -(-n_words // (m["buckets"] * BUCKET)) or 1, f"{store}/words")
    if len(m["hot_hash"]):
        turns = -(-n_tokens // (m["hot_buckets"] * BUCKET)) or 1
        asks = _hot_asks(own, m["hot_hash"], m["hot_buckets"], False)
        told = told.unionByName(_look_up_counts(model.table("hot"), asks, turns, f"{store}/hot"))
    turns = -(-n_tokens // (m["shards"] * TURN)) or 1
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def look_up(tries: pa.Table, rows: pa.Table) -> pa.Table:
        return _answer(rows, shared.value, tries, False) if rows.num_rows else _table(Model.TRIES, [])

    lanes = (model.table("tries", Model.TRIES).where("piece = -1").select("shard", "levels")
             .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))))
    found = lanes.groupBy("shard", "turn").cogroup(_dealt(own, told, m, turns).groupBy("shard", "turn")).applyInArrow(look_up, Model.TRIES)
    return _scores(own, found, m["total"], docs.schema[id_col].dataType.simpleString())


@register("op4_language_model")
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, got = train_and_score(docs, ~held_out("doc_id", 7, 2))
    return got.withColumnRenamed("id", "doc_id").withColumn("mark", ~F.col("mark")).withColumnRenamed("mark", "held_out")
