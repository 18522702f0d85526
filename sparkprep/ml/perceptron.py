"""A perceptron with one hidden layer (M-19): sigmoid units, softmax, cross entropy, by L-BFGS over the whole table.

Rows are packed once into blocks of numbers; every evaluation multiplies the
blocks of a partition with numpy and sends one sum of loss and gradient, so the
driver sees partitions times weights and no rows.  Layers, start weights (their
distribution), steps and the ends of the search are those of Spark's
``MultilayerPerceptronClassifier``, which still fits tables of at most
``PLAIN_ROWS`` rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import q
from .persist import read_arrays, write_arrays

PLAIN_ROWS = 1 << 14
#: Rows multiplied at once, steps that L-BFGS remembers, and last values whose mean gain tells that it ended.
CHUNK, MEMORY, LAST = 2048, 10, 20


def _layers(u: np.ndarray, sizes: tuple) -> tuple:
    """(W1, b1, W2, b2) of a flat array of weights."""
    d, h, k = sizes
    a, b, c = d * h, d * h + h, d * h + h + h * k
    return u[:a].reshape(d, h), u[a:b], u[b:c].reshape(h, k), u[c:]


def scores(u: np.ndarray, sizes: tuple, x: np.ndarray) -> tuple:
    """Hidden units and outputs before the softmax."""
    w1, b1, w2, b2 = _layers(u, sizes)
    hidden = 0.5 + 0.5 * np.tanh(0.5 * (x @ w1 + b1))
    return hidden, hidden @ w2 + b2


def shares(out: np.ndarray) -> np.ndarray:
    e = np.exp(out - out.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(u: np.ndarray, sizes: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over the rows of the cross entropy, then of its gradient."""
    total = np.zeros(1 + len(u))
    for lo in range(0, len(x), CHUNK):
        a, b = x[lo:lo + CHUNK], y[lo:lo + CHUNK]
        hidden, out = scores(u, sizes, a)
        p, at = shares(out), np.arange(len(a))
        total[0] -= np.log(np.maximum(p[at, b], 1e-300)).sum()
        p[at, b] -= 1.0
        back = (p @ _layers(u, sizes)[2].T) * hidden * (1.0 - hidden)
        total[1:] += np.concatenate([(a.T @ back).ravel(), back.sum(axis=0), (hidden.T @ p).ravel(), p.sum(axis=0)])
    return total


def minimise(value_and_gradient, u: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """L-BFGS with steps that satisfy the Wolfe conditions."""
    (value, grad), past, values = value_and_gradient(u), deque(maxlen=MEMORY), deque(maxlen=LAST + 1)
    values.append(value)
    for step in range(steps):
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        way, kept = -grad, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ way))
            way = way - kept[-1] * y
        if past:
            s, y, r = past[-1]
            way = way / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept)):
            way = way + (a - r * (y @ way)) * s
        slope = grad @ way
        if slope >= 0:
            past.clear()
            way, slope = -grad, -(grad @ grad)
        low, high, t = 0.0, np.inf, 1.0 if past else 1.0 / np.linalg.norm(grad)
        for _ in range(30):
            new, g = value_and_gradient(u + t * way)
            if new > value + 1e-4 * t * slope:
                high = t
            elif g @ way < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if np.isfinite(high) else 2 * t
        if new >= value:
            break
        s, y = t * way, g - grad
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            past.append((s, y, 1.0 / (s @ y)))
        u, value, grad = u + s, new, g
        values.append(value)
        if len(values) > LAST and (values[0] - value) / LAST <= tol * abs(value):
            break
    return u


class PerceptronModel:
    def __init__(self, weights: np.ndarray, sizes: tuple, features: str = "features"):
        self.weights, self.sizes, self.features = np.asarray(weights, dtype=np.float64), tuple(sizes), features

    def transform(self, df: DataFrame) -> DataFrame:
        u, sizes = self.weights, self.sizes

        @F.pandas_udf("raw array<double>, probability array<double>")
        def answered(v: pd.Series) -> pd.DataFrame:
            if len(v) == 0:
                return pd.DataFrame({"raw": [], "probability": []}, dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            out = np.concatenate([scores(u, sizes, x[lo:lo + CHUNK])[1] for lo in range(0, len(x), CHUNK)])
            return pd.DataFrame({"raw": list(out), "probability": list(shares(out))})

        p = F.col("__out.probability")
        out = df.withColumn("__out", answered(vector_to_array(F.col(self.features))))
        return (out.withColumn("rawPrediction", array_to_vector(F.col("__out.raw"))).withColumn("probability", array_to_vector(p))
                .withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double")).drop("__out"))

    def save(self, spark, path: str) -> str:
        write_arrays(spark, path, {"weights": self.weights, "sizes": self.sizes})
        return self.features

    @classmethod
    def load(cls, spark, path: str, described: str) -> "PerceptronModel":
        a = read_arrays(spark, path)
        return cls(a["weights"], tuple(int(s) for s in a["sizes"]), described)


def fit_perceptron(est, train: DataFrame, label: str, features: str = "features", plain_rows: int = PLAIN_ROWS):
    """``est``, a Spark perceptron with one hidden layer, fitted on ``train``."""
    n = train.count()
    if n <= plain_rows:
        return est.fit(train)
    sizes, steps, tol = tuple(est.getLayers()), est.getMaxIter(), est.getTol()
    d, h, k = sizes

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False)
                y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    rows = train.select(vector_to_array(F.col(features)).alias("x"), F.col(q(label)).cast("double").alias("y"))
    # hundreds of short jobs follow: an RDD of blocks needs no plan for each
    packed = rows.mapInArrow(pack, "x binary, y binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)

    def value_and_gradient(u):
        def part(blocks):
            total = None
            for x, y in blocks:
                got = loss_and_gradient(u, sizes, np.frombuffer(x).reshape(-1, d), np.frombuffer(y, dtype=np.int64))
                total = got if total is None else total + got
            return [] if total is None else [total]

        total = sum(packed.mapPartitions(part).collect()) / n
        return total[0], total[1:]

    rng = np.random.default_rng(est.getSeed())
    start = np.concatenate([rng.uniform(-2.4, 2.4, (d + 1) * h) / np.sqrt(d), rng.uniform(-2.4, 2.4, (h + 1) * k) / np.sqrt(h)])
    try:
        return PerceptronModel(minimise(value_and_gradient, start, steps, tol), sizes, features)
    finally:
        packed.unpersist()
