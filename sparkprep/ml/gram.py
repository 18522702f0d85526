"""Sums of outer products of wide rows, by blocks: one matrix a partition, then a tree of sums.

A plan with an aggregate expression per pair of columns grows with d²; here a
partition multiplies its batches with numpy and hands on one d×d matrix around
its own mean, and matrices meet ``FAN`` by ``FAN``, so no task or driver holds
more than that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32
_FIELDS = "slot int, n bigint, m binary"


def _matrix(data) -> np.ndarray:
    """Mean (first row) and S of a part, of (d + 1)·d numbers."""
    m = np.frombuffer(data, dtype=np.float64)
    return m.reshape(-1, int(math.sqrt(len(m))))


def gram(rows: DataFrame) -> tuple:
    """(n, mean, S) of the array column ``x``: S = Σ (x − mean)(x − mean)ᵀ.

    A partition's sums are taken around its first row, so that a large common offset does not cancel digits."""
    def partial(batches):
        n, m, origin = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            if m is None:
                origin, m = x[0].copy(), np.zeros((x.shape[1] + 1, x.shape[1]))
            x = x - origin
            n += len(x)
            m[0] += x.sum(axis=0)
            m[1:] += x.T @ x
        if n:
            m[0] /= n
            m[1:] -= n * np.outer(m[0], m[0])
            m[0] += origin
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([m.tobytes()], pa.binary())], ["slot", "n", "m"])

    def added(table: pa.Table) -> pa.Table:
        n, m = 0, None
        for k, x in zip(table.column("n").to_pylist(), table.column("m")):
            part = _matrix(x.as_buffer())
            if m is None:
                n, m = k, part.copy()
                continue
            gap = part[0] - m[0]
            m[1:] += part[1:] + n * k / (n + k) * np.outer(gap, gap)
            m[0] += k / (n + k) * gap
            n += k
        return pa.table([pa.array([table.column("slot")[0].as_py()], pa.int32()), pa.array([n], pa.int64()),
                         pa.array([m.tobytes()], pa.binary())], names=["slot", "n", "m"])

    parts = rows.select("x").mapInArrow(partial, _FIELDS)
    for width in (FAN * FAN, FAN, 1):
        parts = parts.withColumn("slot", F.pmod("slot", F.lit(width))).groupBy("slot").applyInArrow(added, _FIELDS)
    r = parts.first()
    if r is None:
        return 0, np.empty(0), np.empty((0, 0))
    m = _matrix(r["m"])
    return r["n"], m[0], m[1:]
