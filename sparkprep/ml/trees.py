"""Decision trees without a depth bound (M-06, M-13).

Spark ML grows the top of the tree over the whole table (its depth is bounded,
and its splits come from binned candidates).  Every leaf that is still mixed
goes on.  One of at most ``TASK_ROWS`` rows is grown with exact splits until it
is pure, can't be split or reaches the wanted depth; a task takes many of them
side by side.  All larger ones of a round are split at once, each in a task over
the filled cells of bins of its own rows, until their parts are small enough.
Only a leaf of more rows in which no single split helps (equal features, say)
stays mixed.  A class tree of more than ``PLAIN_ROWS`` rows has no top by Spark:
its root is such a large leaf.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import q
from ..session import cut_lineage, default_parallelism
from .cells import ACCURACY, PLAIN_ROWS
from .persist import read_arrays, write_arrays

TASK_ROWS, TOP_DEPTH, SEED = 1 << 15, 10, 42
#: Levels of the first tree beyond those that even splits would need, and its depth at most.
SPARE_LEVELS, MOST_DEPTH = 5, 20
#: Rows whose leaves a task grows side by side: on average at most, and at least if there are as many packs as tasks.
PACK_ROWS, FEW_ROWS = 1 << 16, 1 << 10
#: Rows of one pack of grown leaves that a task scores.
SCORE_ROWS = 1 << 17
#: A model of at most so many nodes is sent to the rows; the rows go to the trees of a larger one.
SENT_NODES = 1 << 20
#: Bins a feature of a large leaf, and filled cells of it that one task takes at most.
LEAF_BINS, MOST_CELLS = 32, 1 << 17
_PACK = "pack int, slices int, leaf array<bigint>, feature binary, threshold binary, below binary, value binary"
_KINDS = {"feature": np.int32, "threshold": np.float64, "below": np.int32, "value": np.float64}
_CELLS = "leaf long, cell binary, y double, w long"
_SPLIT = "leaf long, feature array<int>, threshold array<double>, below array<int>, value array<double>"


def grow(x: np.ndarray, y: np.ndarray, classes: int, depth: int | None, weight: np.ndarray | None = None, tried: int | None = None,
         rng: np.random.Generator | None = None, held: np.ndarray | None = None, most: int = 0) -> tuple:
    """(feature, threshold, first child, value) by node; feature -1 marks a leaf, the children of a node stand side by side.

    ``weight`` is the number of table rows that a row stands for (1 without it).  With ``tried`` a node looks at so many features,
    drawn by ``rng``, and is a leaf if none of them varies, as in Spark's forests, and a class value is the shares of all classes (a tree of a forest).
    Splits lower the Gini impurity (``classes`` > 0) or the squared error (0) most; of equal ones the first feature and the lowest
    threshold.  A node is a leaf if its labels are equal, no feature varies, or ``depth`` is reached; also if its rows hold at most
    ``most``, where ``held`` tells what a row holds."""
    if classes and not tried:
        return grow_groups(x, y, classes, depth, weight, held=held, most=most)
    order = np.lexsort((y, *x.T[::-1]))
    x, y = x[order], y[order]
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=np.float64)[order]
    held = None if held is None else held[order]
    z = (np.eye(classes)[y.astype(np.int64)] if classes else (y - np.average(y, weights=w))[:, None]) * w[:, None]
    feature, threshold, below, value = [], [], [], []

    def node(rows):
        feature.append(-1), threshold.append(0.0), below.append(-1)
        if classes and tried:
            shares = z[rows].sum(axis=0)
            value.append(shares / shares.sum())
            return len(feature) - 1
        value.append(float(np.bincount(y[rows].astype(np.int64), w[rows]).argmax()) if classes else float(np.average(y[rows], weights=w[rows])))
        return len(feature) - 1

    todo = [(node(np.arange(len(y))), np.arange(len(y)), 0)]
    while todo:
        at, rows, level = todo.pop()
        own = y[rows]
        if (own == own[0]).all() or (depth is not None and level >= depth) or (held is not None and held[rows].sum() <= most):
            continue
        best, seen = None, 0
        for f in range(x.shape[1]) if tried is None else rng.permutation(x.shape[1]).tolist():
            if seen == tried:
                break
            seen += 1
            by = np.argsort(x[rows, f], kind="stable")
            v = x[rows[by], f]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            s, n = np.cumsum(z[rows[by]], axis=0), np.cumsum(w[rows[by]])[:, None]
            left, right = s[:-1][cut], s[-1] - s[:-1][cut]
            gain = (left ** 2 / n[:-1][cut] + right ** 2 / (n[-1] - n[:-1][cut])).sum(axis=1)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0] + 1e-12 * abs(best[0]):
                a, b = v[cut[k]], v[cut[k] + 1]
                mid = a + (b - a) / 2
                best = (gain[k], f, mid if a <= mid < b else a)
        if best is None:
            continue
        _, f, t = best
        feature[at], threshold[at] = f, t
        low = x[rows, f] <= t
        below[at] = node(rows[low])
        node(rows[~low])
        todo += [(below[at], rows[low], level + 1), (below[at] + 1, rows[~low], level + 1)]
    return feature, threshold, below, value


def grow_groups(x: np.ndarray, y: np.ndarray, classes: int, depth, weight: np.ndarray | None = None, first: np.ndarray | None = None,
                held: np.ndarray | None = None, most: int = 0) -> tuple:
    """The class trees of ``grow`` for groups of rows that begin at rows ``first``, level by level; node i is the root of group i.

    ``depth`` may be an array, by group.  The rows stay sorted by node and feature; a level looks at each a few times."""
    n = len(y)
    columns = np.ascontiguousarray(np.asarray(x, dtype=np.float64).T)
    z = np.zeros((classes, n))
    z[y.astype(np.int64), np.arange(n)] = 1.0 if weight is None else weight
    sizes = np.diff(np.append(np.zeros(1, dtype=np.int64) if first is None else first, n))
    limit = np.broadcast_to(np.inf if depth is None else np.asarray(depth, dtype=np.float64), len(sizes))
    group = np.repeat(np.arange(len(sizes)), sizes)
    orders = [np.lexsort((c, group)) for c in columns]
    levels, made, level = [], 0, 0

    def only(some):
        rows = np.repeat(some, sizes)
        return [o[rows] for o in orders], sizes[some]

    while len(sizes):
        made += len(sizes)
        starts = np.cumsum(sizes) - sizes
        totals = np.add.reduceat(z[:, orders[0]], starts, axis=1)
        feature, threshold, below = np.full(len(sizes), -1), np.zeros(len(sizes)), np.full(len(sizes), -1)
        levels.append((feature, threshold, below, totals.argmax(axis=0).astype(np.float64)))
        some = ((totals > 0).sum(axis=0) > 1) & (limit > level)
        if held is not None:
            some &= np.add.reduceat(held[orders[0]], starts) > most
        at = np.flatnonzero(some)
        orders, sizes = only(some)
        by, cuts = _best_splits(columns, orders, z, sizes, totals[:, at])
        some = by >= 0
        at, by, cuts = at[some], by[some], cuts[some]
        orders, sizes = only(some)
        if not len(sizes):
            break
        feature[at], threshold[at], below[at] = by, cuts, made + 2 * np.arange(len(at))
        limit = np.repeat(limit[at], 2)
        node, starts = np.repeat(np.arange(len(at)), sizes), np.cumsum(sizes) - sizes
        high = np.zeros(n, dtype=bool)
        high[orders[0]] = ~(columns[by[node], orders[0]] <= cuts[node])
        low = np.add.reduceat((~high[orders[0]]).astype(np.int64), starts)
        before = np.cumsum(low) - low
        for i, o in enumerate(orders):  # the rows of a node part in two runs and keep their order
            lows = np.cumsum(~high[o]) - before[node]
            orders[i] = np.empty_like(o)
            orders[i][np.where(high[o], low[node] + np.arange(len(o)) - lows, starts[node] + lows - 1)] = o
        sizes = np.column_stack([low, sizes - low]).ravel()
        level += 1
    return tuple(np.concatenate(c).tolist() for c in zip(*levels))


def _best_splits(columns: np.ndarray, orders: list, z: np.ndarray, sizes: np.ndarray, totals: np.ndarray) -> tuple:
    """Feature (-1: none) and threshold by node of the lowest Gini impurity; ``orders``: rows by node and feature, ``totals``: sums by class and node."""
    best, by, cuts = np.zeros(len(sizes)), np.full(len(sizes), -1), np.zeros(len(sizes))
    if not len(sizes):
        return by, cuts
    node, starts, all_ = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, totals.sum(axis=0)
    same = node[1:] == node[:-1]
    for f, o in enumerate(orders):
        v = columns[f, o]
        cut = np.flatnonzero((v[1:] > v[:-1]) & same)
        if not len(cut):
            continue
        s, own = np.zeros((len(z), len(o) + 1)), node[cut]
        np.cumsum(z[:, o], axis=1, out=s[:, 1:])
        left = s[:, cut + 1] - s[:, starts[own]]
        n, right = left.sum(axis=0), totals[:, own] - left
        gain = (left ** 2 / n + right ** 2 / (all_[own] - n)).sum(axis=0)
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        top = np.maximum.reduceat(gain, heads)
        hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(heads, len(own)))))
        hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])]  # the lowest threshold of the best
        at = own[heads]
        better = (by[at] < 0) | (top > best[at] + 1e-12 * np.abs(best[at]))
        at, hit, top = at[better], hit[better], top[better]
        a, b = v[cut[hit]], v[cut[hit] + 1]
        mid = a + (b - a) / 2
        best[at], by[at], cuts[at] = top, f, np.where((a <= mid) & (mid < b), mid, a)
    return by, cuts


def walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, below, value = (np.asarray(c) for c in tree)
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(feature[at] >= 0)
        if not len(open_):
            return value[at]
        f = feature[at[open_]]
        at[open_] = below[at[open_]] + (x[open_, f] > threshold[at[open_]])


class Nodes:
    """Nodes below the leaves of Spark's tree: ``entry`` has the root of a leaf's tree, -1 without one; ``level`` counts from that leaf."""

    def __init__(self, entry=(), feature=(), threshold=(), below=(), value=(), level=()):
        self.entry = np.asarray(entry, dtype=np.int64)
        self.feature, self.threshold, self.below, self.value, self.level = (
            np.asarray(c, dtype=k) for c, k in zip((feature, threshold, below, value, level), (np.int64, np.float64, np.int64, np.float64, np.int64)))

    def __len__(self):
        return len(self.feature)

    def grafted(self, packs: list) -> "Nodes":
        """With the trees of (leaves, feature, threshold, first child, value) each in the place of their leaves, as ``walked`` numbers those.

        The root of leaf i of a pack is its node i, and a node stands before its children."""
        most = max([int(max(p[0])) for p in packs if len(p[0])], default=-1)
        entry = np.append(self.entry, np.full(max(0, most + 1 - len(self.entry)), -1))
        parts, at, roots = [(self.feature, self.threshold, self.below, self.value, self.level)], len(self), []
        for leaves, feature, threshold, below, value in packs:
            leaves, feature, below = (np.asarray(c, dtype=np.int64) for c in (leaves, feature, below))
            level = np.zeros(len(feature), dtype=np.int64)
            level[:len(leaves)] = [0 if leaf >= 0 else self.level[-1 - leaf] for leaf in leaves]
            for i in np.flatnonzero(feature >= 0):
                level[below[i]:below[i] + 2] = level[i] + 1
            parts.append((feature, threshold, np.where(feature >= 0, below + at, -1), value, level))
            roots += [(leaf, at + i) for i, leaf in enumerate(leaves.tolist())]
            at += len(feature)
        out = Nodes(entry, *(np.concatenate([np.asarray(p[i]) for p in parts]) for i in range(5)))
        for leaf, root in roots:
            if leaf >= 0:
                out.entry[leaf] = root
            else:  # a node takes the place of the root
                for c in (out.feature, out.threshold, out.below, out.value):
                    c[-1 - leaf] = c[root]
        return out

    def walked(self, leaf: np.ndarray, x: np.ndarray, value: np.ndarray) -> tuple:
        """Leaf (node i is -1 - i) and value of rows that have reached ``leaf`` and ``value`` in Spark's tree."""
        leaf, value = leaf.astype(np.int64), value.astype(np.float64)
        here = np.flatnonzero(leaf < len(self.entry))
        at = self.entry[leaf[here]]
        here, at = here[at >= 0], at[at >= 0]
        at = _steps(self.feature, self.threshold, self.below, at, x[here])
        leaf[here], value[here] = -1 - at, self.value[at]
        return leaf, value


def _steps(feature, threshold, below, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, open_ = at.copy(), np.arange(len(at))
    while True:
        open_ = open_[feature[at[open_]] >= 0]
        if not len(open_):
            return at
        f = at[open_]
        at[open_] = below[f] + (x[open_, feature[f]] > threshold[f])


def _matrix(lists) -> np.ndarray:
    """Rows of equally long lists."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def _arrays(tree: dict) -> dict:
    return {"leaf": np.array(tree["leaf"], dtype=np.int64), **{c: np.frombuffer(tree[c], dtype=k) for c, k in _KINDS.items()}}


class DeepTreeModel:
    """``top``: Spark's tree, if any; ``nodes``: those of its large leaves, or of the root; ``grown``: the leaves grown to the end, in packs, ``size`` nodes and
    ``slices`` slices in all."""

    def __init__(self, top, nodes: Nodes, grown: DataFrame | None, size: int = 0, slices: int = 0, features: str = "features"):
        self.top, self.nodes, self.grown, self.size, self.slices, self.features = top, nodes, grown, size, slices, features
        self._whole = None

    def transform(self, df: DataFrame) -> DataFrame:
        df = df.drop("prediction")
        if self.grown is None:
            return _through(df, self.top, self.nodes, self.features).drop("__leaf")
        if len(self.nodes) + self.size <= SENT_NODES:
            return _through(df, self.top, self._all_nodes(), self.features).drop("__leaf")
        rows = _through(df, self.top, self.nodes, self.features)
        return _met(rows, self.grown, self.slices, self.features).select(*[F.col(q(c)) for c in rows.columns if c not in ("__leaf", "prediction")], "prediction")

    def _all_nodes(self) -> Nodes:
        if self._whole is None:
            packs = self.grown.toArrow().to_pylist()  # at most SENT_NODES nodes
            self._whole = self.nodes.grafted([tuple(_arrays(p).values()) for p in packs])
        return self._whole

    def save(self, spark: SparkSession, path: str) -> str:
        if self.top is not None:
            PipelineModel(stages=[self.top]).write().overwrite().save(f"{path}/top")
        write_arrays(spark, f"{path}/nodes", vars(self.nodes))
        if self.grown is not None:
            self.grown.write.mode("overwrite").parquet(f"{path}/grown")
        return json.dumps({"size": self.size, "slices": self.slices, "top": self.top is not None, "grown": self.grown is not None, "features": self.features})

    @classmethod
    def load(cls, spark: SparkSession, path: str, described: str) -> "DeepTreeModel":
        about = json.loads(described)
        top = PipelineModel.load(f"{path}/top").stages[0] if about["top"] else None
        grown = spark.read.schema(_PACK).parquet(f"{path}/grown") if about["grown"] else None
        return cls(top, Nodes(**read_arrays(spark, f"{path}/nodes")), grown, about["size"], about["slices"], about["features"])


def _through(df: DataFrame, top, nodes: Nodes, features: str) -> DataFrame:
    """Each row with its leaf ``__leaf`` and the answer ``prediction`` of the last node it reaches."""
    if top is None:
        out = df.withColumn("prediction", F.lit(0.0)).withColumn("__leaf", F.lit(0).cast("long"))
    else:
        model = top.copy()
        model.setFeaturesCol(features).setPredictionCol("prediction")
        model.set(model.leafCol, "__l")
        extra = [c for c in ("rawPrediction", "probability") if c not in df.columns]
        out = model.transform(df).drop(*extra).withColumn("__leaf", F.col("__l").cast("long")).drop("__l")
    if not len(nodes):
        return out
    sent = df.sparkSession.sparkContext.broadcast(nodes)

    def walked(leaf: pa.Array, x: pa.Array, value: pa.Array) -> pa.Array:
        leaf, value = sent.value.walked(leaf.to_numpy(zero_copy_only=False), _matrix(x), value.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(leaf), pa.array(value)], names=["leaf", "value"])

    # what is nondeterministic is not copied into the filters of a later join
    walked = F.arrow_udf(walked, "struct<leaf:bigint,value:double>").asNondeterministic()
    out = out.withColumn("__to", walked("__leaf", vector_to_array(F.col(features)), "prediction"))
    return out.withColumn("__leaf", F.col("__to.leaf")).withColumn("prediction", F.col("__to.value")).drop("__to")


def _met(rows: DataFrame, grown: DataFrame, slices: int, features: str) -> DataFrame:
    """The answers of grown leaves: rows are dealt to the packs of their leaves and follow the pack's trees, in one pass over them.

    A pack that many rows were trained on has slices, each with a copy of the trees; rows of other leaves are dealt by their features."""
    where = grown.select(F.explode("leaf").alias("__leaf"), F.col("pack").alias("__pack"), F.col("slices").alias("__slices"))
    parts = max(default_parallelism(rows.sparkSession), slices)
    trees = grown.select(F.col("pack").alias("__pack"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("__slice"),
                         F.struct("leaf", *_KINDS).alias("__tree"))
    rows = rows.join(F.broadcast(where), "__leaf", "left").withColumn("__x", vector_to_array(F.col(features)))
    rows = rows.withColumn("__slice", F.pmod(F.xxhash64("__x"), F.coalesce("__slices", F.lit(parts))).cast("int"))
    rows = rows.withColumn("__pack", F.coalesce("__pack", F.lit(-1))).withColumn("__tree", F.lit(None).cast(trees.schema["__tree"].dataType))
    both = rows.unionByName(trees, allowMissingColumns=True)
    both = both.repartition(parts, "__pack", "__slice").sortWithinPartitions("__pack", "__slice", F.col("__tree").isNull())

    def followed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        tree, own = None, None
        for trees, packs, leaf, x, value in batches:
            packs, given, out = packs.to_numpy(), value.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(packs))
            heads = np.flatnonzero(np.append(True, (packs[1:] != packs[:-1]) | ~given[1:] | (given[1:] != given[:-1])))
            for a, b in zip(heads, np.append(heads[1:], len(packs))):
                if not given[a]:
                    tree, own = _arrays(trees[int(a)].as_py()), packs[a]
                    continue
                n = b - a
                out[a:b] = value.slice(a, n).to_numpy(zero_copy_only=False)
                if packs[a] >= 0 and packs[a] == own:
                    l = leaf.slice(a, n).to_numpy(zero_copy_only=False)
                    at = _steps(tree["feature"], tree["threshold"], tree["below"], np.searchsorted(tree["leaf"], l), _matrix(x.slice(a, n)))
                    out[a:b] = tree["value"][at]
            yield pa.array(out, mask=~given)

    # it holds the trees of the last pack, so the order of its rows must stay: Spark keeps it for what it takes as nondeterministic
    answer = F.arrow_udf(followed, "double").asNondeterministic()
    return both.withColumn("prediction", answer("__tree", "__pack", "__leaf", "__x", "prediction")).where(F.col("prediction").isNotNull())


def _leaf_trees(rows: DataFrame, leaves: list, limits: list, task: str, n_classes: int, task_rows: int, features: str,
                fallback) -> list:
    """([leaf], feature, threshold, first child, value) of large ``leaves``: split over cells of their own bins to parts of ``task_rows``.

    ``fallback`` fits a leaf of too many filled cells."""
    probs = [i / LEAF_BINS for i in range(1, LEAF_BINS)]
    own = rows.where(F.col("__leaf").isin(leaves))
    x = vector_to_array(F.col(features))
    d = own.select(F.size(x)).first()[0]
    found = own.select("__leaf", x.alias("x")).groupBy("__leaf").agg(
        F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("low"), F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("high"),
        *[F.percentile_approx(F.col("x")[i], probs, ACCURACY).alias(f"q{i}") for i in range(d)]).collect()  # a row a large leaf
    edges = {r["__leaf"]: [np.unique([v for v in [low, *r[f"q{i}"]] if v < high]) for i, (low, high) in enumerate(zip(r["low"], r["high"]))]
             for r in found}
    sent = rows.sparkSession.sparkContext.broadcast(edges)
    classes = task == "classification"

    def binned(batches):
        for b in batches:
            if not b.num_rows:
                continue
            leaf, x = b.column(0).to_numpy(), _matrix(b.column(1))
            cell = np.zeros(x.shape, dtype=np.int16)
            for k in np.unique(leaf):
                some = np.flatnonzero(leaf == k)
                for i, e in enumerate(sent.value[k]):
                    cell[some, i] = np.searchsorted(e, x[some, i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in cell], pa.binary()), b.column(2), b.column(3)],
                                             ["leaf", "cell", "y", "w"])

    cells = own.select("__leaf", x.alias("x"), F.col("y").cast("double"), F.col("w").cast("long")).mapInArrow(binned, _CELLS)
    cells = cells.groupBy("leaf", "cell", "y").agg(F.sum("w").alias("w"), F.count("*").alias("held")) if classes else \
        cells.groupBy("leaf", "cell").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w"), F.count("*").alias("held"))
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    wide = {r[0] for r in cells.groupBy("leaf").count().where(F.col("count") > MOST_CELLS).select("leaf").collect()}
    limit = dict(zip(leaves, limits))

    def split(key, t):
        leaf = key[0].as_py()
        cell = np.frombuffer(b"".join(t.column("cell").to_pylist()), dtype=np.int16).reshape(t.num_rows, -1).astype(np.float64)
        f, cut, below, value = grow(cell, t.column("y").to_numpy(), n_classes, limit[leaf], t.column("w").to_numpy(),
                                    held=t.column("held").to_numpy(), most=task_rows)
        cut = [float(sent.value[leaf][i][math.floor(c)]) if i >= 0 else 0.0 for i, c in zip(f, cut)]  # the edge between two bins
        return pa.table([pa.array([leaf]), pa.array([f], pa.list_(pa.int32())), pa.array([cut], pa.list_(pa.float64())),
                         pa.array([below], pa.list_(pa.int32())), pa.array([value], pa.list_(pa.float64()))],
                        names=["leaf", "feature", "threshold", "below", "value"])

    slim = cells.where(~F.col("leaf").isin(sorted(wide))) if wide else cells
    got = [([r[0]], *r[1:]) for r in slim.repartition(max(default_parallelism(rows.sparkSession), len(leaves)), "leaf").groupBy("leaf").applyInArrow(
        split, _SPLIT).collect()]  # nodes over bins, down to task_rows rows
    cells.unpersist()
    return got + [([k], *_spark_nodes(fallback(own.where(F.col("__leaf") == k).drop("__leaf", "prediction"), limit[k]))) for k in sorted(wide)]


def _spark_nodes(model) -> tuple:
    """(feature, threshold, first child, value) of a Spark tree without nominal features."""
    feature, threshold, below, value = [], [], [], []

    def node(j):
        feature.append(-1), threshold.append(0.0), below.append(-1), value.append(float(j.prediction()))
        return len(feature) - 1, j

    todo = [node(model._java_obj.rootNode())]
    while todo:
        at, j = todo.pop()
        if j.getClass().getSimpleName() == "InternalNode":
            feature[at], threshold[at] = j.split().featureIndex(), float(j.split().threshold())
            pair = [node(j.leftChild()), node(j.rightChild())]
            below[at] = pair[0][0]
            todo += pair
    return feature, threshold, below, value


def fit_deep_tree(train: DataFrame, label: str, task: str, depth: int | None = None, n_classes: int = 0, features: str = "features",
                  task_rows: int = TASK_ROWS, top_depth: int = TOP_DEPTH, plain_rows: int = PLAIN_ROWS) -> DeepTreeModel:
    """A decision tree grown until its leaves are pure, or to ``depth``.

    Rows of equal features can't be told apart, so below the first Spark tree one row stands for them, with their number as its
    weight.  The first tree is deeper where the rows ask for it, so that few leaves are too large for a task."""
    from .core import room_for_levels
    make = MC.DecisionTreeClassifier if task == "classification" else MR.DecisionTreeRegressor
    y = F.col(q(label)).cast("double")
    plain = train.select(vector_to_array(F.col(features)).alias("x"), y.alias("y"))
    equal = plain.groupBy("x", "y").agg(F.count("*").alias("w"), F.lit(False).alias("many")) if task == "classification" else \
        plain.groupBy("x").agg(F.avg("y").alias("y"), F.count("*").alias("w"), (F.min("y") != F.max("y")).alias("many"))
    equal = equal.persist(StorageLevel.MEMORY_AND_DISK)
    units = equal.select(array_to_vector("x").alias(features), "y", "w", "many")
    labels = sorted(tuple(r) for r in equal.groupBy("y").agg(F.count("*"), F.sum("w")).collect()) if task == "classification" else []  # a row a class
    n_units = sum(r[1] for r in labels) if labels else equal.count()
    bare = sum(r[2] for r in labels) > plain_rows
    first = 0 if bare else max(top_depth, min(MOST_DEPTH, math.ceil(math.log2(max(1, n_units) / task_rows)) + SPARE_LEVELS))
    first = first if depth is None else min(first, depth)

    def tree(rows, level, **columns):
        est = make(maxDepth=level, seed=SEED, featuresCol=features, minInstancesPerNode=1, **columns)
        room_for_levels(est, rows, features)
        return est.fit(rows)

    if bare:
        most = max(labels, key=lambda r: r[2])[0]
        top, nodes = None, Nodes(entry=[0], feature=[-1], threshold=[0.0], below=[-1], value=[most], level=[0])
    else:
        top, nodes = tree(train, first, labelCol=label), Nodes()

    def left(leaf):
        """Levels that may follow a leaf."""
        return None if depth is None else depth - first - (0 if leaf >= 0 else int(nodes.level[-1 - leaf]))

    stuck: set = set()
    sizes = None
    while depth is None or depth > first:
        rows = _through(units, top, nodes, features)
        if sizes is not None:
            sizes.unpersist()
        sizes = rows.groupBy("__leaf").agg(F.count("*").alias("n"), ((F.min("y") != F.max("y")) | F.max("many")).alias("mixed"),
                                           F.sum("w").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        large = [r[0] for r in sizes.where((F.col("n") > task_rows) & F.col("mixed")).select("__leaf").collect() if r[0] not in stuck]
        stuck |= {k for k in large if depth is not None and left(k) <= 0}  # deep enough
        large = [k for k in large if k not in stuck]
        if not large:
            break
        got = _leaf_trees(rows, large, [left(k) for k in large], task, n_classes, task_rows, features,
                          lambda part, most: tree(part, top_depth if most is None else min(top_depth, most), labelCol="y", weightCol="w"))
        stuck |= {t[0][0] for t in got if t[1][0] < 0}  # too many rows that no single split tells apart: a leaf
        nodes = nodes.grafted([t for t in got if t[1][0] >= 0])
    if depth is not None and depth <= first:
        equal.unpersist()
        return DeepTreeModel(top, nodes, None, features=features)
    open_ = sizes.where("mixed and n > 1").where(~F.col("__leaf").isin(sorted(stuck)) if stuck else F.lit(True)).select("__leaf")
    tasks = default_parallelism(train.sparkSession)
    packs = max(1, math.ceil(n_units / max(PACK_ROWS, 2 * task_rows)), min(tasks, n_units // FEW_ROWS))
    pack = F.pmod(F.xxhash64("__leaf"), F.lit(packs)).cast("int")
    todo = rows.join(open_, "__leaf").select(pack.alias("pack"), "__leaf", vector_to_array(F.col(features)).alias("x"), "y", "w")
    levels = nodes.level

    def work(key, t):
        leaf = t.column("__leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, x = leaf[order], _matrix(t.column("x").combine_chunks())[order]
        y, w = (t.column(c).to_numpy()[order] for c in ("y", "w"))
        own, start = np.unique(leaf, return_index=True)
        most = None if depth is None else [depth - first - (0 if k >= 0 else int(levels[-1 - k])) for k in own]
        if n_classes:
            got = grow_groups(x, y, n_classes, most, w, start)
        else:
            trees = [grow(x[a:b], y[a:b], 0, None if depth is None else most[i], w[a:b])
                     for i, (a, b) in enumerate(zip(start, np.append(start[1:], len(y))))]
            got = _side_by_side(trees)
        slices = math.ceil(w.sum() / SCORE_ROWS)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([slices], pa.int32()), pa.array([own], pa.list_(pa.int64())),
                         *(pa.array([np.asarray(c, dtype=k).tobytes()], pa.binary()) for k, c in zip(_KINDS.values(), got))],
                        names=["pack", "slices", "leaf", *_KINDS])

    spread = todo.repartition(max(tasks, packs), "pack")
    grown = cut_lineage(spread.groupBy("pack").applyInArrow(work, _PACK))
    sizes.unpersist()
    equal.unpersist()
    size, slices = grown.agg(F.sum(F.length("feature")), F.sum("slices")).first()
    return DeepTreeModel(top, nodes, grown, (size or 0) // np.dtype(_KINDS["feature"]).itemsize, slices or 0, features)


def _side_by_side(trees: list) -> tuple:
    """Several trees as the nodes of one pack: the roots first."""
    n, at, out = len(trees), len(trees), [[], [], [], []]
    tails = [[], [], [], []]
    for feature, threshold, below, value in trees:
        shift = at - 1  # node k > 0 of this tree becomes k + shift
        below = [b + shift if b >= 0 else -1 for b in below]
        for head, tail, c in zip(out, tails, (feature, threshold, below, value)):
            head.append(c[0])
            tail += c[1:]
        at += len(feature) - 1
    assert at == n + len(tails[0])
    return tuple(head + tail for head, tail in zip(out, tails))
