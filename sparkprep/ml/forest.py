"""Random forests over binned rows (M-07, M-13).

A forest of a hundred trees reads the table a hundred times a level, but its
trees see a feature only through its bins.  Rows of the same bins differ in
nothing but their label, so a tree needs of its bag no more than the number of
drawn rows (by class) or their number and label sum, cell by cell.  The rows
are drawn one by one (each tree takes a row a Poisson(1) number of times, as
Spark's forests do; of equal rows, the sum), summed by cell and tree, and every
tree grows in a task of its own over the filled cells.  Splits are thresholds,
a node tries a third of the features (regression) or their square root
(classification), and leaves answer with their mean or class shares.

A table with more than ``MOST_CELLS`` filled cells, or with at most
``PLAIN_ROWS`` rows, gets Spark's own forest over its rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import bins_of
from .gram import FAN
from .persist import read_arrays, write_arrays
from .trees import grow, walk

#: Up to this many rows the forest is Spark's, over the rows themselves; filled cells that one tree's task takes at most.
PLAIN_ROWS, MOST_CELLS = 1 << 14, 1 << 17
#: Cells that a task holds before it adds up the equal ones.
HELD_CELLS = 1 << 15
_BAGS = "tree int, slot int, cells binary, drawn binary, total binary"
_TREE = "tree int, feature array<int>, threshold array<double>, below array<int>, value array<double>"


class ForestModel:
    """``trees``: (feature, threshold, first child, value) each, value a mean or the class shares of a node."""

    def __init__(self, trees: list, n_classes: int, features: str = "features"):
        self.trees, self.n_classes, self.features = trees, n_classes, features

    def transform(self, df: DataFrame) -> DataFrame:
        trees, width = df.sparkSession.sparkContext.broadcast(self.trees), max(self.n_classes, 1)

        @F.pandas_udf("array<double>")
        def summed(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(np.float64)
            return pd.Series(list(sum(walk(t, x).reshape(-1, width) for t in trees.value)))

        out = df.withColumn("__sum", summed(vector_to_array(F.col(self.features))))
        total, n = F.col("__sum"), len(self.trees)
        if not self.n_classes:
            return out.withColumn("prediction", total[0] / n).drop("__sum")
        best = F.array_position(total, F.array_max(total)) - 1
        return (out.withColumn("rawPrediction", array_to_vector(total)).withColumn("probability", array_to_vector(F.transform(total, lambda s: s / n)))
                .withColumn("prediction", best.cast("double")).drop("__sum"))

    def save(self, spark, path: str) -> str:
        names = ("feature", "threshold", "below", "value")
        write_arrays(spark, path, {f"{n}{i}": a for i, t in enumerate(self.trees) for n, a in zip(names, t)})
        return json.dumps({"trees": len(self.trees), "classes": self.n_classes, "features": self.features})

    @classmethod
    def load(cls, spark, path: str, described: str) -> "ForestModel":
        a, about = read_arrays(spark, path), json.loads(described)
        trees = [(a[f"feature{i}"].astype(np.int64), a[f"threshold{i}"], a[f"below{i}"].astype(np.int64), a[f"value{i}"]) for i in range(about["trees"])]
        return cls(trees, about["classes"], about["features"])


def added_up(cells: np.ndarray, *sums: np.ndarray) -> tuple:
    """The distinct rows of ``cells`` and the sums of the other arrays' rows over equal ones."""
    if not len(cells):
        return (cells, *sums)
    order = np.lexsort(cells.T[::-1])
    cells = cells[order]
    head = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
    return (cells[head], *(np.add.reduceat(s[order], head, axis=0) for s in sums))


def bags(rows: DataFrame, n_trees: int, width: int, classes: bool, seed: int) -> DataFrame:
    """What the trees drew of ``rows`` (x, y, w: alike rows): by tree, cells of ``width`` numbers, rows drawn and sum of their labels.

    With ``classes`` the label is the last number of a cell, so that the rows of a cell are told apart by it."""
    def draw(batches):
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        held, size = [], 0

        def sent():
            cells, drawn, total = added_up(*(np.concatenate(c) for c in zip(*held)))
            for t in range(n_trees):
                some = drawn[:, t] > 0
                yield [t, part % FAN, cells[some].tobytes(), drawn[some, t].tobytes(), total[some, t].tobytes()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                                              ["tree", "slot", "cells", "drawn", "total"])

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            drawn = rng.poisson(w[:, None], (len(y), n_trees)).astype(np.float64)
            held.append(added_up(np.column_stack([x, y]) if classes else x, drawn, drawn * y[:, None]))
            size += len(held[-1][0])
            if size > HELD_CELLS:
                held, size = [added_up(*(np.concatenate(c) for c in zip(*held)))], 0
                if len(held[0][0]) > HELD_CELLS:  # mostly different cells: on to the trees with them
                    yield batch_of(list(sent()))
                    held = []
        if held:
            yield batch_of(list(sent()))

    def add(table: pa.Table) -> pa.Table:
        cells, drawn, total = together(table, width)
        return pa.table([table.column("tree")[:1], table.column("slot")[:1], pa.array([cells.tobytes()], pa.binary()),
                         pa.array([drawn.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=table.column_names)

    return rows.mapInArrow(draw, _BAGS).groupBy("tree", "slot").applyInArrow(add, _BAGS)


def together(table: pa.Table, width: int) -> tuple:
    cells, drawn, total = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.float64) for c in ("cells", "drawn", "total"))
    return added_up(cells.reshape(-1, width), drawn, total)


def fit_forest(est, train: DataFrame, label: str, n_classes: int = 0, features: str = "features", plain_rows: int = PLAIN_ROWS,
               most_cells: int = MOST_CELLS):
    """``est``, a Spark forest, fitted on the rows of ``train``; over the cells of its bins where there are many rows."""
    if train.count() <= plain_rows:
        return est.fit(train)
    classes, n_trees, depth, seed = n_classes > 0, est.getNumTrees(), est.getMaxDepth(), est.getSeed()
    bins = bins_of(train, features, est.getMaxBins(), "__binned")
    rows = bins.transform(train).select(vector_to_array(F.col("__binned")).alias("x"), F.col(label).cast("double").alias("y"))
    if rows.agg(F.approx_count_distinct("x")).first()[0] > most_cells:
        return est.fit(train)
    sizes, edges, at = bins.getOrDefault(bins.sizes), bins.getOrDefault(bins.edges), 0
    own = []
    for n in sizes:
        own.append(np.array(edges[at:at + n]) if n >= 0 else None)
        at += max(n, 0)
    d = len(sizes)
    tried = math.ceil(math.sqrt(d)) if classes else math.ceil(d / 3)
    # alike rows of a class are drawn at once: their numbers add up to a Poisson number
    alike = rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("w")) if classes else rows.withColumn("w", F.lit(1.0))

    def work(key, table):
        tree = key[0].as_py()
        cells, drawn, total = together(table, d + classes)
        x, y = (cells[:, :-1], cells[:, -1]) if classes else (cells, total / drawn)
        f, thr, below, value = grow(x, y, n_classes, depth, drawn, tried, np.random.default_rng([seed, 1 << 20, tree]))
        # a threshold between two bins is the edge between them
        thr = [float(own[i][math.floor(t)]) if i >= 0 and own[i] is not None else t for i, t in zip(f, thr)]
        return pa.table([pa.array([tree], pa.int32()), pa.array([f], pa.list_(pa.int32())), pa.array([thr], pa.list_(pa.float64())),
                         pa.array([below], pa.list_(pa.int32())), pa.array([np.ravel(value)], pa.list_(pa.float64()))],
                        names=["tree", "feature", "threshold", "below", "value"])

    drawn = bags(alike, n_trees, d + classes, classes, seed)
    got = drawn.repartition(n_trees, "tree").groupBy("tree").applyInArrow(work, _TREE).collect()  # trees of bounded depth and cells
    trees = [(np.array(r["feature"]), np.array(r["threshold"]), np.array(r["below"]),
              np.array(r["value"]).reshape((-1, n_classes) if classes else (-1,))) for r in sorted(got, key=lambda r: r["tree"])]
    return ForestModel(trees, n_classes, features)
