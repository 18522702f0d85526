"""Boosted trees over binned rows (M-05, M-08, M-17).

Spark's tree learners see a feature only through its bins.  Rows of the same
bins and label differ in nothing such a learner reads: one row, with their
number as its weight, stands for them (for a squared loss also for rows of the
same bins, with their mean label).  A hundred rounds then run over as many rows
as there are filled cells, at most the rows of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import q

#: Up to this many rows a learner reads the rows themselves; and one whose classes are boosted by a task each.
PLAIN_ROWS, PLAIN_CLASS_ROWS = 1 << 18, 1 << 14
#: Filled cells (told apart by class) that such a task takes at most.
MOST_CELLS = 1 << 17
#: Relative accuracy of the quantiles that bound the bins.
ACCURACY = 10000


class Bins(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Each component of a vector column becomes the number of its edges below it; one without edges stays."""

    edges = Param(Params._dummy(), "edges", "ascending edges of all components", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "number of edges of each component, -1 where it stays", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, edges=None, sizes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        edges, at, out = self.getOrDefault(self.edges), 0, []
        x = vector_to_array(F.col(self.getInputCol()))
        for i, n in enumerate(self.getOrDefault(self.sizes)):
            v = F.col("__v")[i]
            if n >= 0:
                own = edges[at:at + n]
                v = sum([F.when(F.col("__v")[i] > F.lit(e), 1.0).otherwise(0.0) for e in own], F.lit(0.0))
                at += n
            out.append(v)
        about = df.schema[self.getInputCol()].metadata
        return df.withColumn("__v", x).withColumn(self.getOutputCol(), array_to_vector(F.array(*out)).alias(self.getOutputCol(), metadata=about)).drop("__v")


def bins_of(train: DataFrame, features: str, most: int, out: str) -> Bins:
    """At most ``most`` bins a component between quantiles of all rows; nominal components stay."""
    attrs = train.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    nominal = {a["idx"] for a in attrs.get("nominal", ())} | {a["idx"] for a in attrs.get("binary", ())}
    x = train.select(vector_to_array(F.col(features)).alias("x"))
    d = x.select(F.size("x")).first()[0]
    some = [i for i in range(d) if i not in nominal]
    probs = [i / most for i in range(1, most)]
    row = x.agg(*[F.array(F.min(F.col("x")[i]), F.max(F.col("x")[i])).alias(f"m{i}") for i in some],
                *[F.percentile_approx(F.col("x")[i], probs, ACCURACY).alias(f"q{i}") for i in some]).first()
    edges, sizes = [], []
    for i in range(d):
        if i in nominal:
            sizes.append(-1)
            continue
        lo, hi = row[f"m{i}"]
        own = sorted({float(v) for v in row[f"q{i}"] or [] if v < hi})  # nothing lies above the largest value
        if lo is not None and lo < hi and len(own) < most - 1:
            own = sorted({*own, float(lo)})
        edges += own
        sizes.append(len(own))
    return Bins(inputCol=features, outputCol=out, edges=edges, sizes=sizes)


def cells_of(binned: DataFrame, column: str, label: str, classes: bool) -> DataFrame:
    """One row for the rows of the same bins (and class): ``column``, ``label`` (its mean) and their number ``__w``."""
    about = binned.schema[column].metadata
    rows = binned.select(vector_to_array(F.col(column)).alias("__x"), F.col(q(label)).cast("double").alias("__y"))
    got = rows.groupBy("__x", "__y").agg(F.count("*").cast("double").alias("__w")) if classes else \
        rows.groupBy("__x").agg(F.avg("__y").alias("__y"), F.count("*").cast("double").alias("__w"))
    return got.select(array_to_vector("__x").alias(column, metadata=about), F.col("__y").alias(label), "__w")


def fit_on_cells(est, train: DataFrame, label: str, features: str = "features", plain_rows: int | None = None):
    """``est`` fitted on the rows of ``train``, or on the cells of its bins where there are more than ``plain_rows``."""
    from .boost import can_boost, fit_boosted
    alone = can_boost(est, train, features)
    n_rows = train.count()
    if n_rows <= (plain_rows if plain_rows is not None else PLAIN_CLASS_ROWS if alone else PLAIN_ROWS):
        return est.fit(train)
    inner = est.getClassifier() if isinstance(est, MC.OneVsRest) else est
    bins = bins_of(train, features, inner.getOrDefault("maxBins"), "__binned")
    classes = not inner.__class__.__name__.endswith("Regressor")
    cells = cells_of(bins.transform(train), "__binned", label, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if alone and cells.count() <= MOST_CELLS:
            return PipelineModel(stages=[bins, fit_boosted(est, cells, "__binned", label)])
        if plain_rows is None and n_rows <= PLAIN_ROWS:
            return est.fit(train)
        model = est.copy().setFeaturesCol("__binned").setWeightCol("__w").fit(cells)
    finally:
        cells.unpersist()
    return PipelineModel(stages=[bins, model])
