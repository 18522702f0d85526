"""Learners that Spark ML does not ship (M-10, M-11, M-16, M-18).

* ``fit_sgd_regressor`` – the objective of a default SGD linear regressor
  (squared loss + α/2·‖w‖², α = 1e-4, unpenalised intercept) solved exactly
  from one distributed pass of blocked Gram sums (d×d numbers reach the driver).
* ``fit_linear_svr`` – ε-insensitive linear SVR (C = 1, ε = 0.1) by Newton
  steps whose sums cover the whole table.
* ``fit_rbf_svm`` – RBF-kernel SVM over Nyström landmarks, as many as a measured
  kernel error asks for, feeding ``LinearSVC`` (one-vs-rest when multiclass)
  or, beyond ``PLAIN_ROWS`` rows, its objective over packed blocks.
* ``fit_adaboost`` – SAMME with 50 weighted depth-1 trees; sample weights are
  a column, lineage is cut by checkpoints into the shared checkpoint folder.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import q
from ..session import cut_lineage
from .gram import gram
from .perceptron import CHUNK, PLAIN_ROWS, minimise
from .persist import read_arrays, write_arrays
from .scaler import FEW


class LinearModel:
    def __init__(self, coef, intercept, features="features"):
        self.coef = np.asarray(coef, dtype=np.float64)
        self.intercept = float(intercept)
        self.features = features

    def transform(self, df: DataFrame) -> DataFrame:
        if len(self.coef) <= FEW:
            x, total = vector_to_array(F.col(self.features)), F.lit(self.intercept)
            for i, c in enumerate(self.coef):
                total = total + x[i] * F.lit(float(c))
            return df.withColumn("prediction", total)
        coef = F.array(*[F.lit(float(c)) for c in self.coef]).cast("array<double>")
        terms = F.zip_with(vector_to_array(F.col(self.features)), coef, lambda x, c: x * c)
        return df.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda total, v: total + v))

    def save(self, spark, path: str) -> str:
        write_arrays(spark, path, {"coef": self.coef, "intercept": [self.intercept]})
        return self.features

    @classmethod
    def load(cls, spark, path: str, described: str) -> "LinearModel":
        a = read_arrays(spark, path)
        return cls(a["coef"], a["intercept"][0], described)


def _xy(df: DataFrame, label: str, features: str = "features") -> DataFrame:
    return df.select(vector_to_array(F.col(features)).alias("x"), F.col(q(label)).cast("double").alias("y"))


def fit_sgd_regressor(train: DataFrame, label: str, alpha: float = 1e-4, features: str = "features") -> LinearModel:
    """M-11: minimiser of mean ½(y − w·x − b)² + α/2‖w‖² from one aggregate pass."""
    xy = _xy(train, label, features)
    n, mean, sums = gram(xy.select(F.concat("x", F.array("y")).alias("x")))
    g = sums[:-1, :-1] / n
    w = np.linalg.solve(g + alpha * np.eye(len(g)), sums[:-1, -1] / n)
    return LinearModel(w, mean[-1] - mean[:-1] @ w, features)


def fit_linear_svr(train: DataFrame, label: str, c: float = 1.0, epsilon: float = 0.1, smooth: float = 1e-3,
                   tol: float = 1e-9, features: str = "features") -> LinearModel:
    """M-10: ε-insensitive linear SVR (primal ½‖w‖² + C·Σ max(0, |r|−ε), free intercept).

    Newton's method on the whole table: every step sums loss, gradient and
    Hessian per partition and then by Spark, so (d+1)² + d + 2 numbers reach the
    driver and the result does not depend on the partitioning.  Features and
    target are standardised for the solve only; the penalty stays on the
    original weights.  The loss is smoothed by softplus, its width lowered from
    0.3 to ``smooth`` target deviations; each width is solved until the Newton
    decrement falls below ``tol``."""
    xy = _xy(train, label, features).persist(StorageLevel.MEMORY_AND_DISK)
    d = xy.select(F.size("x")).first()[0]
    stats = xy.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"),
                   F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("mx"),
                   F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(d)]).alias("sx")).first()
    n, my, sy = stats["n"], stats["my"], stats["sy"] or 1.0
    mx, sx = np.array(stats["mx"]), np.array([v or 1.0 for v in stats["sx"]])
    eps = epsilon / sy
    ridge = np.append(sy / (c * n * sx * sx), 0.0)

    def sums(u, width):
        def part(batches):
            total = 0.0
            for p in batches:
                if p.num_rows:
                    x = p.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    x = np.hstack([(x - mx) / sx, np.ones((len(x), 1))])
                    r = (p.column(1).to_numpy(zero_copy_only=False) - my) / sy - x @ u
                    over, under = (r - eps) / width, (-r - eps) / width
                    up, down = 0.5 + 0.5 * np.tanh(over / 2), 0.5 + 0.5 * np.tanh(under / 2)
                    loss = width * (np.logaddexp(0, over) + np.logaddexp(0, under)).sum()
                    bend = (up * (1 - up) + down * (1 - down)) / width
                    total = total + np.concatenate([[loss], x.T @ (down - up), ((x * bend[:, None]).T @ x).ravel()])
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        got = np.zeros(1 + (d + 1) + (d + 1) ** 2)
        for r in xy.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r["i"]] = r["v"] / n
        return (got[0] + 0.5 * (ridge * u * u).sum(), got[1:d + 2] + ridge * u,
                got[d + 2:].reshape(d + 1, d + 1) + np.diag(ridge + 1e-10))

    u, width = np.zeros(d + 1), 0.3
    while True:
        value, grad, hess = sums(u, width)
        while True:
            step = np.linalg.solve(hess, grad)
            gain, t = float(grad @ step), 1.0
            if gain < tol:
                break
            new = sums(u - step, width)
            while new[0] > value - 1e-4 * t * gain and t > 1e-6:
                t /= 2
                new = sums(u - t * step, width)
            if new[0] >= value:
                break
            u, (value, grad, hess) = u - t * step, new
        if width <= smooth:
            break
        width = max(smooth, width / 3)
    xy.unpersist()
    w = sy * u[:-1] / sx
    return LinearModel(w, my + sy * u[-1] - float(w @ mx), features)


class NystroemModel:
    """Features ``K(x, landmarks) · K(landmarks, landmarks)^(−1/2)`` of the RBF kernel, then a linear SVM."""

    def __init__(self, landmarks, gamma: float, svm=None, error: float = 0.0, features="features", weights=None):
        self.landmarks, self.gamma, self.svm, self.error, self.features = np.asarray(landmarks), gamma, svm, error, features
        #: Instead of ``svm``: a margin's weight of each landmark's kernel, then the intercept; a column a class (one of two classes: of the second)
        self.weights = weights
        values, vectors = np.linalg.eigh(rbf(self.landmarks, self.landmarks, gamma))
        good = values > 1e-10 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def lift_array(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.root

    def lift(self, df: DataFrame) -> DataFrame:
        landmarks, root, gamma = self.landmarks, self.root, self.gamma

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def lifted(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            return pd.Series([row for lo in range(0, len(x), 1024) for row in rbf(x[lo:lo + 1024], landmarks, gamma) @ root])

        # a lifted row has up to MAX_RANK numbers
        return df.withColumn("__rbf", array_to_vector(lifted(vector_to_array(F.col(self.features)))))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.landmarks, self.gamma) @ self.weights[:-1] + self.weights[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        if self.weights is None:
            out = self.svm.transform(self.lift(df))
            return out.drop("__rbf", "rawPrediction")
        answered = self.margins

        @F.pandas_udf(T.DoubleType())
        def predicted(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=np.float64)
            x = np.stack(v.to_numpy()).astype(np.float64)
            m = np.concatenate([answered(x[lo:lo + CHUNK]) for lo in range(0, len(x), CHUNK)])
            return pd.Series((m[:, 0] > 0 if m.shape[1] == 1 else m.argmax(axis=1)).astype(np.float64))

        return df.withColumn("prediction", predicted(vector_to_array(F.col(self.features))))

    def save(self, spark, path: str) -> str:
        arrays = {"landmarks": self.landmarks, "gamma": [self.gamma], "error": [self.error]}
        write_arrays(spark, f"{path}/kernel", arrays if self.weights is None else arrays | {"weights": self.weights})
        if self.weights is None:
            PipelineModel(stages=[self.svm]).write().overwrite().save(f"{path}/svm")
        return self.features

    @classmethod
    def load(cls, spark, path: str, described: str) -> "NystroemModel":
        a = read_arrays(spark, f"{path}/kernel")
        if "weights" in a:
            return cls(a["landmarks"], float(a["gamma"][0]), None, float(a["error"][0]), described, a["weights"])
        return cls(a["landmarks"], float(a["gamma"][0]), PipelineModel.load(f"{path}/svm").stages[0], float(a["error"][0]), described)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


#: Rows that are landmarks at most, rows on which the kernel's error is measured, and the error (root mean square) that is small enough.
MAX_RANK, TEST_ROWS, KERNEL_ERROR = 1024, 512, 0.01


def fit_rbf_svm(train: DataFrame, label: str, n_classes: int, kernel_error: float = KERNEL_ERROR, max_rank: int = MAX_RANK,
                features: str = "features") -> NystroemModel:
    """M-16: SVM with the kernel exp(−γ‖x−y‖²), γ = 1 / (d · Var(X)) ('scale'), approximated by landmarks (Nyström).

    Landmarks are training rows in hash order.  Their number doubles until the
    kernel of ``TEST_ROWS`` other rows is met with a root mean square error of at
    most ``kernel_error``, or ``max_rank`` is reached; ``error`` tells what it is."""
    arr = vector_to_array(F.col(features))
    n, mean, sums = gram(train.select(arr.alias("x")))
    d = len(mean)
    var = np.trace(sums) / (n * d) + ((mean - mean.mean()) ** 2).mean()
    gamma = 1.0 / (d * var) if var > 0 else 1.0
    distinct = train.select(arr.alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(max_rank + TEST_ROWS)
    rows = np.array([r[0] for r in distinct.collect()], dtype=np.float64)
    test, pool = rows[:min(TEST_ROWS, len(rows) // 3)], rows[min(TEST_ROWS, len(rows) // 3):]
    exact, rank = rbf(test, test, gamma), min(64, len(pool))
    while True:
        model = NystroemModel(pool[:rank], gamma, features=features)
        lifted = model.lift_array(test)
        model.error = float(np.sqrt(((lifted @ lifted.T - exact) ** 2).mean())) if len(test) else 0.0
        if model.error <= kernel_error or rank >= min(max_rank, len(pool)):
            break
        rank = min(2 * rank, max_rank, len(pool))
    if n > PLAIN_ROWS:
        model.weights = _fit_margins(model, train.select(arr.alias("x"), F.col(q(label)).cast("double").alias("y")), n, n_classes)
        return model
    svc = MC.LinearSVC(featuresCol="__rbf", labelCol=label, regParam=1.0 / max(n, 1), maxIter=100)
    est = MC.OneVsRest(classifier=svc, featuresCol="__rbf", labelCol=label) if n_classes > 2 else svc
    model.svm = est.fit(model.lift(train))
    return model


def _fit_margins(model: NystroemModel, rows: DataFrame, n: int, n_classes: int) -> np.ndarray:
    """The objective of ``LinearSVC`` (mean hinge loss + 1/2n·‖v‖² over lifted features of unit deviation, free intercept) for
    all classes against the rest in one search, so that each pass over the rows serves every class.

    Rows stay packed blocks of their own few numbers; a pass works out their kernels by numpy and sends one gradient a partition."""
    landmarks, root, gamma, d = model.landmarks, model.root, model.gamma, model.landmarks.shape[1]
    k = n_classes if n_classes > 2 else 1
    origin = model.lift_array(landmarks).mean(axis=0)

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                part = b.slice(lo, CHUNK)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    # hundreds of short jobs follow: an RDD of blocks needs no plan for each
    packed = rows.mapInArrow(pack, "x binary, y binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(of_block):
        def part(blocks):
            total = None
            for x, y in blocks:
                got = of_block(rbf(np.frombuffer(x).reshape(-1, d), landmarks, gamma), np.frombuffer(y, dtype=np.int64))
                total = got if total is None else total + got
            return [] if total is None else [total]
        return sum(packed.mapPartitions(part).collect())

    def moments(kernel, _):
        z = kernel @ root - origin
        return np.stack([z.sum(axis=0), (z * z).sum(axis=0)])

    try:
        first, second = summed(moments) / n
        mean, spread = origin + first, np.sqrt(np.maximum(second - first * first, 0) * n / max(n - 1, 1))
        factor = np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0)

        def of_kernel(u):
            """Weights of the kernels and intercepts for the weights of unit features."""
            v = u.reshape(-1, k)
            w = v[:-1] * factor[:, None]
            return np.vstack([root @ w, v[-1] - mean @ w])

        def value_and_gradient(u):
            w = of_kernel(u)

            def hinge(kernel, y):
                sign = np.where(y[:, None] == (np.arange(k) if k > 1 else 1), 1.0, -1.0)
                short = 1.0 - sign * (kernel @ w[:-1] + w[-1])
                back = np.where(short > 0, -sign, 0.0)
                return np.vstack([kernel.T @ back, back.sum(axis=0), np.maximum(short, 0).sum(axis=0)])

            got = summed(hinge) / n
            v, slope = u.reshape(-1, k), got[-2]
            grad = (root.T @ got[:-2] - np.outer(mean, slope)) * factor[:, None] + v[:-1] / n
            return got[-1].sum() + 0.5 / n * (v[:-1] ** 2).sum(), np.vstack([grad, slope]).ravel()

        return of_kernel(minimise(value_and_gradient, np.zeros((root.shape[1] + 1) * k), 100, 1e-6))
    finally:
        packed.unpersist()


class AdaBoostModel:
    """Stumps are (feature, threshold, left class, right class); prediction is a
    column expression: argmax_k Σ_m α_m·[stump_m(x) = k]."""

    def __init__(self, stumps, alphas, n_classes, features="features"):
        self.stumps, self.alphas, self.n_classes, self.features = stumps, alphas, n_classes, features

    def save(self, spark, path: str) -> str:
        write_arrays(spark, path, {"stumps": self.stumps, "alphas": self.alphas, "classes": [self.n_classes]})
        return self.features

    @classmethod
    def load(cls, spark, path: str, described: str) -> "AdaBoostModel":
        a = read_arrays(spark, path)
        stumps = [(int(f), float(t), int(lo), int(hi)) for f, t, lo, hi in a["stumps"].reshape(-1, 4)]
        return cls(stumps, [float(x) for x in a["alphas"]], int(a["classes"][0]), described)

    def votes(self, x):
        scores = []
        for k in range(self.n_classes):
            s = F.lit(0.0)
            for (f, thr, left, right), a in zip(self.stumps, self.alphas):
                pred = F.when(x[f] <= F.lit(thr), F.lit(left)).otherwise(F.lit(right))
                s = s + F.when(pred == k, F.lit(a)).otherwise(F.lit(0.0))
            scores.append(s)
        return scores

    def transform(self, df: DataFrame) -> DataFrame:
        arr = df.withColumn("__xa", vector_to_array(F.col(self.features)))  # convert the vector once
        scored = arr.withColumn("__scores", F.array(*self.votes(F.col("__xa"))))
        best = F.array_position(F.col("__scores"), F.array_max(F.col("__scores"))) - 1
        return scored.withColumn("prediction", best.cast("double")).drop("__scores", "__xa")


def _stump_expr(x, stump):
    f, thr, left, right = stump
    return F.when(x[f] <= F.lit(thr), F.lit(float(left))).otherwise(F.lit(float(right)))


def _best_stump(hist, thresholds, k):
    """Weighted-Gini best split from per-(feature, bin, class) weight sums."""
    best = None
    for f, thr in enumerate(thresholds):
        nb = len(thr) + 1
        counts = np.zeros((nb, k))
        for (b, c), w in hist.get(f, {}).items():
            counts[b, c] += w
        total = counts.sum(axis=0)
        left = np.cumsum(counts, axis=0)[:-1]  # split after bin s: bins <= s go left
        for s in range(len(thr)):
            lw, rw = left[s], total - left[s]
            ln, rn = lw.sum(), rw.sum()
            if ln <= 0 or rn <= 0:
                continue
            gini = ln * (1 - ((lw / ln) ** 2).sum()) + rn * (1 - ((rw / rn) ** 2).sum())
            if best is None or gini < best[0] - 1e-15:
                best = (gini, f, float(thr[s]), int(np.argmax(lw)), int(np.argmax(rw)))
    if best is None:  # no split possible: predict the weighted majority everywhere
        tot = np.zeros(k)
        for (b, c), w in hist.get(0, {}).items():
            tot[c] += w
        c = int(np.argmax(tot))
        return (0, float("inf"), c, c), float(tot.sum() - tot[c])
    _, f, thr, lc, rc = best
    counts = np.zeros((len(thresholds[f]) + 1, k))
    for (b, c), w in hist.get(f, {}).items():
        counts[b, c] += w
    s = thresholds[f].index(thr)
    lw, rw = counts[: s + 1].sum(axis=0), counts[s + 1:].sum(axis=0)
    err = float(lw.sum() - lw[lc] + rw.sum() - rw[rc])  # weighted misclassification
    return (f, thr, lc, rc), err


def fit_adaboost(train: DataFrame, label: str, n_classes: int, rounds: int = 50, bins: int = 32,
                 checkpoint_every: int = 10, features: str = "features") -> AdaBoostModel:
    """M-18: SAMME boosting of depth-1 trees (50 rounds, learning rate 1).

    Split candidates are ``bins`` approximate quantiles per feature (as Spark's
    own trees do).  Each round is one aggregate: weighted class totals per
    (feature, bin) – d·bins·K numbers – from which the weighted-Gini stump,
    its weighted error and α are computed.  The weight column is an expression
    of the previous stumps; a checkpoint every few rounds keeps plans small.
    """
    k = max(n_classes, 2)
    x = vector_to_array(F.col(features))
    base = train.select(x.alias("__x"), F.col(q(label)).cast("int").alias("__y"))
    d = base.select(F.size("__x")).first()[0]
    probs = [i / bins for i in range(1, bins)]
    qrow = base.agg(*[F.percentile_approx(F.col("__x")[f], probs, 10000).alias(f"q{f}") for f in range(d)]).first()
    thresholds = [sorted(set(float(v) for v in (qrow[f"q{f}"] or []))) for f in range(d)]
    bin_cols = []
    for f, thr in enumerate(thresholds):
        b = F.lit(len(thr))
        for i in range(len(thr) - 1, -1, -1):
            b = F.when(F.col("__x")[f] <= F.lit(thr[i]), F.lit(i)).otherwise(b)
        bin_cols.append(b)
    n = base.count()
    cur = base.withColumn("__bins", F.array(*bin_cols)).withColumn("__w", F.lit(1.0 / n))
    cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
    held = [cur]
    stumps, alphas = [], []
    for m in range(rounds):
        rows = (cur.select(F.posexplode("__bins").alias("__f", "__b"), "__y", "__w")
                .groupBy("__f", "__b", "__y").agg(F.sum("__w").alias("w")).collect())  # d·bins·K rows
        hist = {}
        for r in rows:
            hist.setdefault(r["__f"], {})[(r["__b"], r["__y"])] = r["w"]
        stump, err = _best_stump(hist, thresholds, k)  # the error comes from the same histogram
        f, thr, left, right = stump
        miss = F.when(F.col("__x")[f] <= F.lit(thr), F.lit(left)).otherwise(F.lit(right)) != F.col("__y")
        if err >= 1.0 - 1.0 / k:
            break
        stumps.append(stump)
        if err <= 0:
            alphas.append(1.0)
            break
        alpha = math.log((1 - err) / err) + math.log(k - 1)
        alphas.append(alpha)
        total = (1.0 - err) + err * math.exp(alpha)  # weights summed to 1 before the update
        nxt = cur.withColumn("__w", F.col("__w") * F.exp(F.lit(alpha) * miss.cast("double")) / F.lit(total))
        if (m + 1) % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        else:
            nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(nxt)
        cur = nxt
        if len(held) > 2:
            held.pop(0).unpersist()
    for h in held:
        h.unpersist()
    return AdaBoostModel(stumps, alphas, k, features)
