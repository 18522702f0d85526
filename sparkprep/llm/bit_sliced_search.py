"""Exact top-k search (11) by integer inner product, over a bit-sliced index.

* **Index.**  Vectors become integers, ``floor(scale * x)``.  A block of
  vectors keeps each component as an attribute: its offset from the block's
  minimum without the ``shift`` lowest bits, stored as one bitmap over the
  block's rows for each remaining bit.  The exact integers stand beside them.
* **Sum.**  A query's components are written in signed binary digits.  Every
  digit adds one attribute's slices (or their complements) to the bitmap
  columns of its weight, and carry-save adders reduce each column to one
  bitmap: the slices of the quantised scores of all rows of the block.
* **Selection.**  From the most significant slice downward the k-th largest
  quantised score is found by counting bits.  The dropped bits are worth at
  most ``(2**shift - 1) * sum |q|``, so rows further below can't be in the top
  k; a second walk down the slices marks all others.
* **Boundary rows** (marked ones, ties included) get their exact products.

Spark deals vectors evenly to blocks of about ``BLOCK`` rows and queries to
groups of about ``GROUP``; each (block, group) pair is one bounded task of work
that returns k rows a query, and a window ranks them.  The index is written to
the shared scratch folder and can be given to any number of searches.

Defined cases: vectors that are null or hold null or non-finite components
take no part; missing components of shorter vectors count as 0; equal scores
go by ascending id, a null id last; rows with the query's own id are never its
answers; a query row that is repeated is answered each time; an empty table
gives an empty result; a vector whose squared integer length reaches 2**62
raises ValueError, as scores would not fit 64 bits.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._fs import scratch_dir
from .registry import read, register

#: Vectors of a block, queries of a group, and bits that the index keeps of a component.
BLOCK, GROUP, KEEP = 1 << 14, 2048, 7


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer vectors, short ones filled with 0)."""
    column = column.cast(pa.large_list(pa.float64()))
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    first = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[first[1:]] == bad[first[:-1]]))
    out = np.zeros((len(rows), int(size[rows].max()) if len(rows) else 0))
    inside = np.arange(out.shape[1]) < size[rows, None]
    out[inside] = np.floor(flat[(first[rows, None] + np.arange(out.shape[1]))[inside]] * scale)
    if len(out) and not ((out ** 2).sum(axis=1) < 2.0 ** 62).all():
        raise ValueError("a vector is too long for 64-bit scores")
    return rows, out.astype(np.int64)


class Slices:
    """The bit-sliced attributes of a block: ``planes`` holds bit b of attribute d at d * bits + b, then all complements."""

    def __init__(self, exact: np.ndarray, keep: int = KEEP):
        self.exact = exact
        n, dims = exact.shape
        offset = exact - exact.min(axis=0) if n else exact
        whole = int(offset.max()).bit_length() if offset.size else 0
        self.n, self.dims, self.shift = n, dims, max(0, whole - keep)
        self.bits, self.words = whole - self.shift, -(-n // 64)
        padded = np.zeros((self.words * 64, dims), dtype=np.int64)
        padded[:n] = offset >> self.shift
        self.planes = np.empty((dims * self.bits, self.words), dtype=np.uint64)
        for b in range(self.bits):
            bit = np.ascontiguousarray((padded >> b & 1).astype(np.uint8).T)
            self.planes[b::self.bits] = np.packbits(bit.ravel(), bitorder="little").view(np.uint64).reshape(dims, self.words)
        self.ready()

    def ready(self) -> "Slices":
        self.both = np.concatenate([self.planes, ~self.planes])
        self.every = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)
        return self

    def sums(self, query: np.ndarray) -> list:
        """Slices of the quantised scores, lowest first; all rows' sums are raised by one common amount."""
        column, plane = self._addends(query)
        order = np.argsort(column, kind="stable")
        column, plane = column[order], plane[order]
        out, carry, at, c = [], [], 0, 0
        while at < len(column) or carry:
            end = int(np.searchsorted(column, c, side="right"))
            sheet = np.empty((end - at + sum(map(len, carry)), self.words), dtype=np.uint64)
            np.take(self.both, plane[at:end], axis=0, out=sheet[:end - at], mode="clip")
            if carry:
                np.concatenate(carry, out=sheet[end - at:])
            bit, carry = _added(sheet)
            out.append(bit)
            at, c = end, c + 1
        return out

    def _addends(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, plane) of every bitmap to add, by the signed binary digits of the query: none of two neighbours is other than 0."""
        rest, weight, places, signs, dims = query.copy(), 0, [], [], []
        while rest.any():
            digit = np.where(rest & 1, 2 - (rest & 3), 0)
            some = np.flatnonzero(digit)
            places.append(np.full(len(some), weight)), signs.append(digit[some]), dims.append(some)
            rest, weight = (rest - digit) >> 1, weight + 1
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, sign, dim = (np.concatenate(x)[:, None] for x in (places, signs, dims))
        b = np.arange(self.bits)
        return (place + b).ravel(), (np.where(sign < 0, len(self.planes), 0) + dim * self.bits + b).ravel()

    def boundary(self, query: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        """Rows of the bitmap ``among`` that can be in its top k."""
        sums = self.sums(query)
        left, need, bound = among, k, 0
        if _count(among) > k:
            for i in range(len(sums) - 1, -1, -1):
                upper = left & sums[i]
                n = _count(upper)
                if n >= need:
                    left, bound = upper, bound | 1 << i
                else:
                    left, need = left & ~sums[i], need - n
            bound -= ((1 << self.shift) - 1) * int(np.abs(query).sum()) >> self.shift
        if bound > 0:
            above, level = np.zeros_like(among), among
            for i in range(len(sums) - 1, -1, -1):
                if bound >> i & 1:
                    level = level & sums[i]
                else:
                    above |= level & sums[i]
                    level = level & ~sums[i]
            among = above | level
        return np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little"))

    def top(self, query: np.ndarray, without: list, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k highest products, equal ones by ``order``; the rows of ``without`` take no part."""
        q = np.zeros(self.dims, dtype=np.int64)
        q[:min(len(query), self.dims)] = query[:self.dims]
        among = self.every
        if without:
            among = among.copy()
            for r in without:
                among[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        rows = self.boundary(q, among, k)
        score = self.exact[rows] @ q
        best = np.lexsort((order[rows], -score))[:k]
        return rows[best], score[best]


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum(dtype=np.int64))


def _added(sheet: np.ndarray) -> tuple[np.ndarray, list]:
    """(sum bit, carries) of the bitmaps of one weight; three become a sum and a carry, again and again.  Overwrites ``sheet``."""
    n, carry = len(sheet), []
    if not n:
        return np.zeros(sheet.shape[1], dtype=np.uint64), carry
    while n > 2:
        t = n // 3
        a, b, c = sheet[:t], sheet[t:2 * t], sheet[2 * t:3 * t]
        half, up = a ^ b, a & b
        up |= half & c
        np.bitwise_xor(half, c, out=a)
        carry.append(up)
        rest = n - 3 * t
        sheet[t:t + rest] = sheet[3 * t:n]
        n = t + rest
    if n == 2:
        carry.append(sheet[:1] & sheet[1:2])
        return sheet[0] ^ sheet[1], carry
    return sheet[0].copy(), carry


def _packed(a: np.ndarray) -> tuple[bytes, str]:
    kind = next(t for t in (np.int16, np.int32, np.int64) if not a.size or (np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max))
    return a.astype(kind).tobytes(), np.dtype(kind).name


def _dealt(vectors: DataFrame, id_col: str, vec_col: str, scale: float, size: int, parts: int, slices: bool) -> DataFrame:
    """Rows dealt evenly to ``parts`` parts and packed: one row a part, or more if it has over twice ``size`` rows."""
    kind = vectors.schema[id_col].dataType.simpleString()
    fields = f"part int, piece int, ids array<{kind}>, dims int, kind string, exact binary" + ", shift int, bits int, planes binary" * slices

    def pack(batches):
        part, piece, have, count = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            rows, x = integers(b.column(1), scale)
            if len(rows):
                have.append((b.column(0).take(pa.array(rows)), x))
                count += len(rows)
            while count >= 2 * size:
                block, have = _first(have, size)
                yield batch(part, piece, *block)
                count, piece = count - size, piece + 1
        if count:
            yield batch(part, piece, *_first(have, count)[0])

    def batch(part, piece, ids, x):
        data, name = _packed(x)
        cols = [pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([x.shape[1]], pa.int32()),
                pa.array([name]), pa.array([data], pa.binary())]
        names = ["part", "piece", "ids", "dims", "kind", "exact"]
        if slices:
            s = Slices(x)
            cols += [pa.array([s.shift], pa.int32()), pa.array([s.bits], pa.int32()), pa.array([s.planes.tobytes()], pa.binary())]
            names += ["shift", "bits", "planes"]
        return pa.RecordBatch.from_arrays(cols, names)

    return vectors.select(id_col, vec_col).repartition(parts).mapInArrow(pack, fields)


def _first(have: list, n: int) -> tuple[tuple, list]:
    """((ids, vectors) of the first n rows, the rest)."""
    ids = pa.concat_arrays([i for i, _ in have])
    wide = max(x.shape[1] for _, x in have)
    x = np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for _, x in have])
    return (ids.slice(0, n), x[:n]), [(ids.slice(n), x[n:])] if len(ids) > n else []


def _exact(row: dict) -> np.ndarray:
    x = np.frombuffer(row["exact"], dtype=row["kind"]).astype(np.int64)
    return x.reshape(len(row["ids"]), row["dims"])


def _opened(row: dict) -> Slices:
    s = Slices.__new__(Slices)
    s.exact, s.n, s.dims, s.shift, s.bits = _exact(row), len(row["ids"]), row["dims"], row["shift"], row["bits"]
    s.words = -(-s.n // 64)
    s.planes = np.frombuffer(row["planes"], dtype=np.uint64).reshape(s.dims * s.bits, s.words)
    return s.ready()


class Index:
    """The bit-sliced index of a table of vectors, as a Parquet table in ``path``."""

    def __init__(self, table: DataFrame, parts: int, kind: str, scale: float):
        self.table, self.parts, self.kind, self.scale = table, parts, kind, scale

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0,
              path: str | None = None, block: int = BLOCK) -> "Index":
        spark = vectors.sparkSession
        path = path or scratch_dir(spark, "bit-slices")
        parts = -(-vectors.count() // block) or 1
        dealt = _dealt(vectors, id_col, vec_col, scale, block, parts, slices=True)
        dealt.write.parquet(path)
        return cls(spark.read.schema(dealt.schema).parquet(path), parts, vectors.schema[id_col].dataType.simpleString(), scale)

    def search(self, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", group: int = GROUP) -> DataFrame:
        """(query_id, rank, vec_id, score): the k highest scores of each row of ``queries``, rows of its own id left out."""
        groups = -(-queries.count() // group) or 1
        asked = _dealt(queries, id_col, vec_col, self.scale, group, groups, slices=False)
        lane, turn = F.expr(f"sequence(0, {self.parts - 1})"), F.expr(f"sequence(0, {groups - 1})")
        left = self.table.withColumnRenamed("part", "lane").withColumn("turn", F.explode(turn))
        right = asked.withColumnRenamed("part", "turn").withColumn("lane", F.explode(lane))
        of = queries.schema[id_col].dataType.simpleString()
        fields = f"turn int, seat int, query_id {of}, vec_id {self.kind}, score bigint"
        found = left.groupBy("lane", "turn").cogroup(right.groupBy("lane", "turn")).applyInArrow(_searcher(k), fields)
        best = Window.partitionBy("turn", "seat").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


def _searcher(k: int):
    def search(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        got = []
        asked_rows = asked.sort_by("piece").to_pylist()
        for row in blocks.to_pylist():
            ids, block = row["ids"], _opened(row)
            rank = np.empty(len(ids), dtype=np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
            own: dict = {}
            for at, i in enumerate(ids):
                own.setdefault(i, []).append(at)
            seat = 0
            for a in asked_rows:
                for i, q in zip(a["ids"], _exact(a)):
                    rows, score = block.top(q, own.get(i, []), rank, k)
                    got += [(a["turn"], seat, i, ids[r], s) for r, s in zip(rows.tolist(), score.tolist())]
                    seat += 1
        of, to = asked.schema.field("ids").type.value_type, blocks.schema.field("ids").type.value_type
        kinds = (pa.int32(), pa.int32(), of, to, pa.int64())
        names = ["turn", "seat", "query_id", "vec_id", "score"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 5, kinds)], names)
    return search


SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding]::DOUBLE[] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op11_topk_search", SQL)
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Index.build(vectors).search(vectors.filter(F.col("vec_id") % 50 == 0))
