"""M-03: scaler stages with the statistics of the table operators (E-05 .. E-07), as Spark ML stages that can be saved.

Standard uses the population deviation, robust the exact quartiles; a constant
component is only shifted, so it becomes 0.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("standard", "minmax", "robust")
#: Components that are written out one by one, which Spark compiles; more would make the plan grow, and go through a lambda.
FEW = 64


class AffineModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``(x − shift) · factor`` for each component of a vector column."""

    shift = Param(Params._dummy(), "shift", "subtracted from each component", TypeConverters.toListFloat)
    factor = Param(Params._dummy(), "factor", "multiplies each component", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, shift=None, factor=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        shift, factor = self.getOrDefault(self.shift), self.getOrDefault(self.factor)
        if len(shift) <= FEW:
            x = vector_to_array(F.col(self.getInputCol()))
            moved = F.array(*[(x[i] - F.lit(float(s))) * F.lit(float(f)) for i, (s, f) in enumerate(zip(shift, factor))])
            return df.withColumn(self.getOutputCol(), array_to_vector(moved))
        shift, factor = (F.array(*[F.lit(float(v)) for v in a]) for a in (shift, factor))
        moved = F.zip_with(vector_to_array(F.col(self.getInputCol())), shift, lambda x, s: x - s)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.zip_with(moved, factor, lambda x, f: x * f)))


class ExactScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    kind = Param(Params._dummy(), "kind", "standard, minmax or robust", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, kind="standard"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AffineModel:
        kind, x = self.getOrDefault(self.kind), vector_to_array(F.col(self.getInputCol()))
        if kind == "robust":
            from ..operators.quantiles import exact_quantiles
            d = df.select(F.size(x)).first()[0]
            names = [f"c{i}" for i in range(d)]
            q = exact_quantiles(df.select(x.alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)]), names, [0.25, 0.5, 0.75])
            stats = [(q[c][1], q[c][2] - q[c][0]) for c in names]
        else:
            v = F.col("v")
            centre, spread = (F.avg(v), F.stddev_pop(v)) if kind == "standard" else (F.min(v), F.max(v) - F.min(v))
            rows = df.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(centre, spread).collect()  # one row a component
            stats = [r[1:] for r in sorted(rows)]
        return AffineModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), shift=[float(c) for c, _ in stats],
                           factor=[1.0 / s if s else 1.0 for _, s in stats])
