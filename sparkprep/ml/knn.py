"""Exact k-nearest neighbours by blocked matrix products (M-09, M-14, O-07).

No (query, row) pair ever becomes a row of a DataFrame:

* training rows are dealt evenly to dense blocks of about ``BLOCK_ROWS``
  vectors (one row of a Parquet table holds a block), queries to groups of
  about ``GROUP_ROWS``;
* each (block, group) pair meets in one task, where one matrix product gives
  all squared distances.  Rounding errors of that form are bounded, so every
  row within the bound of a query's k-th distance gets its distance by
  differences, and the k best stay, ties by training id;
* the k best of a group travel as one packed row.  Packed rows are merged
  ``FAN`` blocks at a time, level by level, so a merge holds at most
  ``FAN * GROUP_ROWS * k`` neighbours, however many blocks there are.

Blocks hold any vectors, so near-copies or a skewed region make no block
larger.  ``categorical`` counts trailing components that are codes: each
mismatch adds ``mismatch**2`` to the squared distance.  Vectors must not be
null; a NaN distance is the largest.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._fs import scratch_dir
from ..operators.relational import q

BLOCK_ROWS, GROUP_ROWS, FAN = 8192, 2048, 64
#: Queries whose distances to a block are held at once, and components of the differences that are.
PART_ROWS, PART_CELLS = 256, 1 << 22


def _vectors(df: DataFrame, id_col: str, features: str, extra=()) -> DataFrame:
    dt = df.schema[features].dataType
    v = F.col(q(features)).cast("array<double>") if isinstance(dt, T.ArrayType) else vector_to_array(F.col(q(features)))
    return df.select(F.col(q(id_col)).alias("__id"), v.alias("__v"), *[F.col(q(c)) for c in extra])


def _packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows (__id, __v, extra...) dealt evenly to ``parts`` parts, one packed row each (more if a part exceeds twice ``size``)."""
    names = [c for c in rows.columns if c != "__v"]
    fields = ["part int", "piece int", "data binary"] + [f"{q(c)} array<{rows.schema[c].dataType.simpleString()}>" for c in names]

    def pack(batches):
        part, piece, have, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            have.append(b)
            n += b.num_rows
            while n >= 2 * size:
                t = pa.Table.from_batches(have)
                yield one(part, piece, t.slice(0, size))
                have, n, piece = t.slice(size).to_batches(), n - size, piece + 1
        if n:
            yield one(part, piece, pa.Table.from_batches(have))

    def one(part, piece, t):
        data = t.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        cols = [pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([data.astype(np.float64).tobytes()], pa.binary())]
        for c in names:
            x = t.column(c).combine_chunks()
            cols.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
        return pa.RecordBatch.from_arrays(cols, ["part", "piece", "data", *names])

    return rows.repartition(parts).mapInArrow(pack, ", ".join(fields))


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=np.float64).reshape(len(row["__id"]), -1)


def nearest(queries: np.ndarray, rows: np.ndarray, rank: np.ndarray, k: int, own: list, categorical: int = 0, mismatch: float = 0.0) -> tuple:
    """(query, row, distance) of the k nearest rows of each query, by query, distance and ``rank``; ``own[i]``: rows that query i leaves out."""
    d = rows.shape[1] - categorical
    x, xc = rows[:, :d], rows[:, d:]
    xx = (x ** 2).sum(axis=1)
    far = float(np.nanmax(np.sqrt(xx), initial=0.0))
    got: list = []
    for lo in range(0, len(queries), PART_ROWS):
        some = queries[lo:lo + PART_ROWS]
        a, ac = some[:, :d], some[:, d:]
        aa = (a ** 2).sum(axis=1)
        near = aa[:, None] + xx - 2 * (a @ x.T)
        for c in range(categorical):
            near += mismatch ** 2 * (ac[:, c, None] != xc[None, :, c])
        near[np.isnan(near)] = np.inf
        for i, gone in enumerate(own[lo:lo + PART_ROWS]):
            near[i, gone] = np.nan
        worst = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(a), np.inf)
        worst[np.isnan(worst)] = np.inf
        slack = 8e-16 * (d + 8) * (np.sqrt(aa) + far) ** 2
        i, j = np.nonzero(near <= (worst + np.where(np.isfinite(slack), slack, np.inf))[:, None])
        dist = np.empty(len(i))
        step = max(1, PART_CELLS // max(1, rows.shape[1]))
        for s in range(0, len(i), step):
            p, r = i[s:s + step], j[s:s + step]
            dist[s:s + step] = np.sqrt(((a[p] - x[r]) ** 2).sum(axis=1) + mismatch ** 2 * (ac[p] != xc[r]).sum(axis=1))
        order = np.lexsort((rank[j], dist, i))
        order = order[_place(i[order]) < k]
        got.append((i[order] + lo, j[order], dist[order]))
    return tuple(np.concatenate(c) for c in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _place(groups: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal ones."""
    new = np.ones(len(groups), dtype=bool)
    new[1:] = groups[1:] != groups[:-1]
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0)) if len(groups) else np.empty(0, np.int64)


def _search(k: int, extra: list, exclude_self: bool, categorical: int, mismatch: float):
    """One (block, group) pair: the packed k best of each query of the group."""
    def run(blocks: pa.Table, groups: pa.Table) -> pa.Table:
        asked = groups.sort_by("piece")
        found = []
        for b, row in enumerate(blocks.to_pylist()):
            x, ids = _matrix(row), row["__id"]
            rank = np.empty(len(ids), dtype=np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
            where: dict = {}
            if exclude_self:
                for at, i in enumerate(ids):
                    where.setdefault(i, []).append(at)
            tid, kept = blocks.column("__id")[b].values, [blocks.column(c)[b].values for c in extra]
            seat = 0
            for g in range(asked.num_rows):
                qid = asked.column("__id")[g].values
                v = np.frombuffer(asked.column("data")[g].as_py(), dtype=np.float64).reshape(len(qid), -1)
                own = [where.get(i, []) for i in qid.to_pylist()] if exclude_self else [[]] * len(qid)
                i, j, dist = nearest(v, x, rank, k, own, categorical, mismatch)
                at = pa.array(j)
                found.append(pa.table([pa.array(i + seat), qid.take(pa.array(i)), tid.take(at), pa.array(dist), *[c.take(at) for c in kept]],
                                      names=["seat", "qid", "tid", "dist", *extra]))
                seat += len(qid)
        if not found:
            return None
        return _best(pa.concat_tables(found), k)

    def whole(blocks, groups):
        rest = [t for t in (blocks, groups) if not t.num_rows]
        out = None if rest else run(blocks, groups)
        if out is None:
            return _none(blocks, groups, extra)
        key = [pa.array([t.column(c)[0].as_py()], pa.int32()) for t, c in ((groups, "turn"), (blocks, "lane"))]
        return pa.table([*key, *out], names=["turn", "lane", "seat", "qid", "tid", "dist", "rank", *extra])
    return whole


def _best(t: pa.Table, k: int) -> list:
    """Packed columns (seat, qid, tid, dist, rank, extra...) of the k best of each seat."""
    t = t.sort_by([("seat", "ascending"), ("dist", "ascending"), ("tid", "ascending")])
    place = _place(t.column("seat").to_numpy())
    t = t.filter(pa.array(place < k)).append_column("rank", pa.array((place[place < k] + 1).astype(np.int32)))
    names = ["seat", "qid", "tid", "dist", "rank", *[c for c in t.column_names if c not in ("seat", "qid", "tid", "dist", "rank")]]
    return [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in names]


def _none(blocks: pa.Table, groups: pa.Table, extra: list) -> pa.Table:
    of = lambda t, c: t.schema.field(c).type
    kinds = {"turn": pa.int32(), "lane": pa.int32(), "seat": pa.list_(pa.int64()), "qid": of(groups, "__id"), "tid": of(blocks, "__id"),
             "dist": pa.list_(pa.float64()), "rank": pa.list_(pa.int32())} | {c: of(blocks, c) for c in extra}
    return pa.table([pa.array([], t) for t in kinds.values()], names=list(kinds))


def _merge(k: int, extra: list):
    """The packed k best of several packed rows of one group of queries."""
    names = ["seat", "qid", "tid", "dist", *extra]

    def run(packed: pa.Table) -> pa.Table:
        flat = pa.table([pa.chunked_array([c.flatten() for c in packed.column(n).chunks]) for n in names], names=names)
        key = [pa.array([packed.column(c)[0].as_py()], pa.int32()) for c in ("turn", "lane")]
        return pa.table([*key, *_best(flat, k)], names=["turn", "lane", "seat", "qid", "tid", "dist", "rank", *extra])
    return run


class KNNIndex:
    """Training rows in dense blocks; answers exact k-NN queries."""

    def __init__(self, train: DataFrame, id_col: str, features: str = "features", extra=(), block_rows: int = BLOCK_ROWS,
                 categorical: int = 0, mismatch: float = 0.0, path: str | None = None):
        self.id_col, self.extra, self.categorical, self.mismatch = id_col, list(extra), categorical, mismatch
        rows = _vectors(train, id_col, features, extra)
        self.path = path or scratch_dir(train.sparkSession, "knn")
        self.lanes = -(-rows.count() // block_rows) or 1
        packed = _packed(rows, block_rows, self.lanes)
        packed.write.parquet(self.path)
        self.blocks = train.sparkSession.read.schema(packed.schema).parquet(self.path)

    def describe(self) -> str:
        return json.dumps({"id_col": self.id_col, "extra": self.extra, "categorical": self.categorical, "mismatch": self.mismatch, "lanes": self.lanes})

    @classmethod
    def open(cls, spark: SparkSession, path: str, described: str) -> "KNNIndex":
        """The index that an earlier session wrote to ``path``."""
        index = cls.__new__(cls)
        index.__dict__.update(json.loads(described))
        index.path, index.blocks = path, spark.read.parquet(path)
        return index

    def query(self, queries: DataFrame, id_col: str, k: int = 5, features: str = "features", exclude_self: bool = False,
              group_rows: int = GROUP_ROWS) -> DataFrame:
        """(qid, tid, dist, rank, extra...) of the k nearest training rows; with ``exclude_self`` rows of the query's own id stay out."""
        rows = _vectors(queries, id_col, features)
        turns = -(-rows.count() // group_rows) or 1
        right = (_packed(rows, group_rows, turns).withColumnRenamed("part", "turn")
                 .withColumn("lane", F.explode(F.expr(f"sequence(0, {self.lanes - 1})"))))
        left = self.blocks.withColumnRenamed("part", "lane").withColumn("turn", F.explode(F.expr(f"sequence(0, {turns - 1})")))
        of = lambda df, c: df.schema[c].dataType.simpleString()
        fields = ["turn int", "lane int", "seat array<bigint>", f"qid {of(right, '__id')}", f"tid {of(left, '__id')}", "dist array<double>",
                  "rank array<int>", *[f"{q(c)} {of(left, c)}" for c in self.extra]]
        best = left.groupBy("lane", "turn").cogroup(right.groupBy("lane", "turn")).applyInArrow(
            _search(k, self.extra, exclude_self, self.categorical, self.mismatch), ", ".join(fields))
        lanes = self.lanes
        while lanes > 1:
            best = (best.withColumn("lane", F.floor(F.col("lane") / FAN).cast("int")).groupBy("turn", "lane")
                    .applyInArrow(_merge(k, self.extra), ", ".join(fields)))
            lanes = -(-lanes // FAN)
        names = ["qid", "tid", "dist", "rank", *self.extra]
        return best.select(F.inline(F.arrays_zip(*[F.col(q(c)) for c in names])))


class KNNModel:
    """k-NN regressor (mean of neighbours' labels) or classifier (majority,
    ties → smallest label), k = 5 by default."""

    def __init__(self, train: DataFrame, id_col: str, label: str, k: int = 5, task: str = "regression",
                 features: str = "features", block_rows: int = BLOCK_ROWS):
        self.k, self.task, self.label, self.features = k, task, label, features
        self.index = KNNIndex(train.withColumnRenamed(label, "__label"), id_col, features, ["__label"], block_rows)

    def transform(self, test: DataFrame, id_col: str | None = None) -> DataFrame:
        id_col = id_col or self.index.id_col
        nn = self.index.query(test, id_col, self.k, self.features)
        if self.task == "regression":
            pred = nn.groupBy("qid").agg(F.avg(F.col("__label").cast("double")).alias("prediction"))
        else:
            votes = nn.groupBy("qid", "__label").agg(F.count(F.lit(1)).alias("__n"))
            w = Window.partitionBy("qid").orderBy(F.col("__n").desc(), F.col("__label").asc())
            pred = (votes.withColumn("__r", F.row_number().over(w)).where("__r = 1")
                    .select("qid", F.col("__label").cast("double").alias("prediction")))
        return test.join(pred.withColumnRenamed("qid", id_col), id_col, "left")

    def save(self, spark: SparkSession, path: str) -> str:
        self.index.blocks.write.mode("overwrite").parquet(path)
        return json.dumps({"k": self.k, "task": self.task, "label": self.label, "features": self.features, "index": self.index.describe()})

    @classmethod
    def load(cls, spark: SparkSession, path: str, described: str) -> "KNNModel":
        model, about = cls.__new__(cls), json.loads(described)
        model.index = KNNIndex.open(spark, path, about.pop("index"))
        model.__dict__.update(about)
        return model
