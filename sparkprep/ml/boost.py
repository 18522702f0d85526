"""Boosted classifiers over the filled cells of bins (M-17).

Spark's boosting runs some jobs a round and class, whatever the size of the
table; what a round reads fits a task as soon as the rows are cells of bins.
Here each class is boosted by one task over all cells, by the rules of Spark's
``GBTClassifier`` (trees of least squared error on the gradient of the log
loss, the first one on the labels and with weight 1) and ``OneVsRest`` (the
class of the largest margin).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import q

#: A purer node is a leaf, as in Spark.
EPSILON = float(np.finfo(np.float64).eps)
_TREES = "class int, start array<int>, feature array<int>, threshold array<double>, below array<int>, value array<double>"


class BoostedModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of all classes one after the other; a margin is the sum of a class's trees.  Two classes have one margin, that of class 1."""

    owner = Param(Params._dummy(), "owner", "class of each tree", TypeConverters.toListInt)
    start = Param(Params._dummy(), "start", "root of each tree", TypeConverters.toListInt)
    feature = Param(Params._dummy(), "feature", "feature of each node, -1 in a leaf", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "largest value that goes to the first child", TypeConverters.toListFloat)
    below = Param(Params._dummy(), "below", "first child of each node", TypeConverters.toListInt)
    value = Param(Params._dummy(), "value", "weighted answer of each node", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol=None, owner=None, start=None, feature=None, threshold=None, below=None, value=None):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        owner, start, feature, threshold, below, value = (np.array(self.getOrDefault(p)) for p in (
            self.owner, self.start, self.feature, self.threshold, self.below, self.value))
        sent, n = df.sparkSession.sparkContext.broadcast((owner, start, feature, threshold, below, value)), int(owner.max()) + 1

        @F.arrow_udf("array<double>")
        def margins(v: pa.Array) -> pa.Array:
            owner, start, feature, threshold, below, value = sent.value
            x, out = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1)), np.zeros((len(v), n))
            for c, root in zip(owner, start):
                at, open_ = np.full(len(x), root), np.arange(len(x))
                while len(open_):
                    open_ = open_[feature[at[open_]] >= 0]
                    f = at[open_]
                    at[open_] = below[f] + (x[open_, feature[f]] > threshold[f])
                out[:, c] += value[at]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(out.ravel()))

        out = df.withColumn("__m", margins(vector_to_array(F.col(self.getFeaturesCol()))))
        m, to = F.col("__m"), self.getPredictionCol()
        if n == 1:
            p = 1.0 / (1.0 + F.exp(-2.0 * m[0]))
            return (out.withColumn("rawPrediction", array_to_vector(F.array(-m[0], m[0]))).withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
                    .withColumn(to, F.when(m[0] > 0, 1.0).otherwise(0.0)).drop("__m"))
        return (out.withColumn("rawPrediction", array_to_vector(m))
                .withColumn(to, (F.array_position(m, F.array_max(m)) - 1).cast("double")).drop("__m"))


def grow_tree(codes: np.ndarray, cuts: list, stats: np.ndarray, depth: int) -> tuple:
    """(feature, threshold, first child, value) by node and the leaf of each cell; ``stats``: rows, label sum and sum of squares by cell.

    ``codes``: by feature the number of thresholds in ``cuts`` below a cell.  Of equal splits the first feature and lowest threshold."""
    at = np.zeros(codes.shape[1], dtype=np.int64)
    feature, threshold, below, value = [-1], [0.0], [-1], []
    rows, node, names = np.arange(len(at)), at, np.zeros(1, dtype=np.int64)

    def spread(c, s, q):
        return (q - s * s / c) / c

    for level in range(depth + 1):
        k = len(names)
        total = np.stack([np.bincount(node, v[rows], k) for v in stats])
        value += (total[1] / total[0]).tolist()
        if level == depth:
            break
        own = spread(*total)
        best, by, cut = np.zeros(k), np.full(k, -1), np.zeros(k, dtype=np.int64)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            width = len(c) + 1
            place = node * width + codes[f, rows]
            left = np.stack([np.bincount(place, v[rows], k * width).reshape(k, width).cumsum(axis=1)[:, :-1] for v in stats])
            right = total[:, :, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = own[:, None] - left[0] / total[0][:, None] * spread(*left) - right[0] / total[0][:, None] * spread(*right)
            gain[(left[0] <= 0) | (right[0] <= 0)] = -np.inf
            top = gain.argmax(axis=1)
            found = gain[np.arange(k), top]
            better = (found > best) & ((level == 0) | (np.abs(own) >= EPSILON))
            best[better], by[better], cut[better] = found[better], f, top[better]
        split = np.flatnonzero(by >= 0)
        if not len(split):
            break
        first = len(feature) + 2 * np.arange(len(split))
        for i, b in zip(split, first):
            feature[names[i]], threshold[names[i]], below[names[i]] = int(by[i]), float(cuts[by[i]][cut[i]]), int(b)
        feature += [-1] * 2 * len(split)
        threshold += [0.0] * 2 * len(split)
        below += [-1] * 2 * len(split)
        new = np.full(k, -1)
        new[split] = np.arange(len(split))
        some = by[node] >= 0
        rows, node = rows[some], node[some]
        node = 2 * new[node] + (codes[by[node], rows] > cut[node])
        names = np.column_stack([first, first + 1]).ravel()
        at[rows] = names[node]
    return (feature, threshold, below, value), at


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int, depth: int, step: float) -> tuple:
    """(roots, feature, threshold, first child, value) of the trees that tell ``pos`` rows of the cells ``x`` from ``neg`` rows."""
    values = [np.unique(c) for c in x.T]
    cuts = [(v[1:] + v[:-1]) / 2 for v in values]
    codes = np.stack([np.searchsorted(v, c) for v, c in zip(values, x.T)])
    margin, start, out = np.zeros(len(x)), [], ([], [], [], [])
    for r in range(rounds):
        a, b = (np.ones(len(x)), -np.ones(len(x))) if r == 0 else (4.0 / (1.0 + np.exp(2.0 * margin)), -4.0 / (1.0 + np.exp(-2.0 * margin)))
        (feature, threshold, below, value), at = grow_tree(codes, cuts, np.stack([pos + neg, pos * a + neg * b, pos * a * a + neg * b * b]), depth)
        value = np.array(value) * (1.0 if r == 0 else step)
        margin += value[at]
        base = len(out[0])
        start.append(base)
        for to, c in zip(out, (feature, threshold, [i + base if i >= 0 else -1 for i in below], value.tolist())):
            to += c
    return start, *out


def can_boost(est, binned: DataFrame, column: str) -> bool:
    """Whether ``est`` is a boosted classifier that only differs from Spark's defaults in rounds, depth, step and bins, on features without levels."""
    inner = est.getClassifier() if isinstance(est, MC.OneVsRest) else est
    if not isinstance(inner, MC.GBTClassifier) or binned.schema[column].metadata.get("ml_attr", {}).get("attrs", {}).keys() & {"nominal", "binary"}:
        return False
    plain = MC.GBTClassifier()
    free = {"maxIter", "maxDepth", "stepSize", "maxBins", "seed", "featuresCol", "labelCol"}
    return all(p.name in free or not inner.isSet(p) or plain.hasDefault(p.name) and inner.getOrDefault(p) == plain.getOrDefault(p.name)
               for p in inner.params)


def fit_boosted(est, cells: DataFrame, column: str, label: str) -> BoostedModel:
    """``est`` over ``cells`` (``column``, ``label``, rows ``__w``), few enough for a task; a task a class."""
    several = isinstance(est, MC.OneVsRest)
    inner = est.getClassifier() if several else est
    rounds, depth, step = inner.getMaxIter(), inner.getMaxDepth(), inner.getStepSize()
    n = int(cells.agg(F.max(q(label))).first()[0]) + 1 if several else 1

    def work(key, t):
        c = key[0].as_py()
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        x, where = np.unique(x, axis=0, return_inverse=True)
        w, mine = t.column("w").to_numpy(), t.column("y").to_numpy() == (c if several else 1)
        where = where.ravel()
        pos, neg = (np.bincount(where, w * part, len(x)) for part in (mine, ~mine))
        got = boost(x, pos, neg, rounds, depth, step)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64())
        return pa.table([pa.array([c], pa.int32()), *(pa.array([g], pa.list_(k)) for g, k in zip(got, kinds))],
                        names=["class", "start", "feature", "threshold", "below", "value"])

    rows = cells.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class"), vector_to_array(F.col(column)).alias("x"),
                        F.col(q(label)).alias("y"), F.col("__w").alias("w"))
    got = sorted(rows.repartition(4 * n, "class").groupBy("class").applyInArrow(work, _TREES).collect(), key=lambda r: r["class"])  # trees of bounded depth
    out = {"owner": [], "start": [], "feature": [], "threshold": [], "below": [], "value": []}
    for r in got:
        base = len(out["feature"])
        out["owner"] += [r["class"]] * len(r["start"])
        out["start"] += [s + base for s in r["start"]]
        out["below"] += [b + base if b >= 0 else -1 for b in r["below"]]
        for c in ("feature", "threshold", "value"):
            out[c] += r[c]
    return BoostedModel(featuresCol=column, **out)
