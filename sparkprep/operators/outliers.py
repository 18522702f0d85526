"""Outliers and class balance (O-*).

Sampling is deterministic and engine-independent: a row's draw order is
``md5(key || ':' || seed)``.  Choosing "the first n rows by draw order" uses
the distributed row index of ``plans.ordered`` (no single-task top-n), so a
class holding a third of the table is still sampled in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ordered as O
from .profile import attach_scalars
from .relational import q


def hash_order(key_col, seed: int) -> Column:
    """Draw order of a row: md5 of ``key:seed`` as text."""
    return F.md5(F.concat(F.col(q(key_col)).cast("string"), F.lit(f":{seed}")))


def hash_int(text_col: Column) -> Column:
    """First 60 bits of an md5 hex digest as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text_col), 1, 15), 16, 10).cast("long")


# ---- outliers -----------------------------------------------------------------

def iqr_bounds(df: DataFrame, col: str) -> DataFrame:
    from .quantiles import quantile_frame
    qf = quantile_frame(df.select(F.col(q(col)).alias("x")), ["x"], [0.25, 0.75], ["q1", "q3"])
    q1, q3 = F.col("x_q1"), F.col("x_q3")
    return qf.select((q1 - 1.5 * (q3 - q1)).alias("__lo"), (q3 + 1.5 * (q3 - q1)).alias("__hi"))


def _iqr_flag(col: str) -> Column:
    return (F.col(q(col)) < F.col("__lo")) | (F.col(q(col)) > F.col("__hi"))


def outliers_iqr(df: DataFrame, col: str) -> DataFrame:
    """O-01: rows strictly outside [Q1 − 1.5·IQR, Q3 + 1.5·IQR]."""
    return attach_scalars(df, iqr_bounds(df, col)).where(_iqr_flag(col)).drop("__lo", "__hi")


def _z_stats(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(F.col(q(col))).alias("__mu"), F.stddev_samp(F.col(q(col))).alias("__sd"))


def zscore_column(col: str) -> Column:
    return F.try_divide(F.col(q(col)) - F.col("__mu"), F.col("__sd"))


def outliers_zscore(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """O-02: rows with |z| > 3 (sample std), with the ``Z-score`` column added."""
    z = attach_scalars(df, _z_stats(df, col)).withColumn("Z-score", zscore_column(col))
    return z.where(F.abs(F.col("Z-score")) > threshold).drop("__mu", "__sd")


def drop_outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """O-03: remove outlier rows; rows with a null value stay."""
    if method == "iqr":
        j = attach_scalars(df, iqr_bounds(df, col))
        return j.where(~F.coalesce(_iqr_flag(col), F.lit(False))).drop("__lo", "__hi")
    if method in ("zscore", "z"):
        j = attach_scalars(df, _z_stats(df, col))
        return j.where(~F.coalesce(F.abs(zscore_column(col)) > threshold, F.lit(False))).drop("__mu", "__sd")
    raise ValueError(f"unknown outlier method {method!r}")


# ---- class sampling ------------------------------------------------------------------

def undersample(df: DataFrame, col: str, cls, n: int, key: str, seed: int = 10) -> DataFrame:
    """O-04: keep ``n`` rows of class ``cls`` (without replacement), others untouched."""
    members = df.where(F.col(q(col)) == F.lit(cls)).withColumn("__h", hash_order(key, seed))
    picked = O.with_row_index(members, ["__h", key]).where(F.col("__idx") < n).drop("__h", "__idx")
    rest = df.where(F.col(q(col)).isNull() | (F.col(q(col)) != F.lit(cls)))
    return rest.unionByName(picked)


def oversample(df: DataFrame, col: str, cls, n: int, key: str, seed: int = 10) -> DataFrame:
    """O-05: ``n`` draws with replacement from class ``cls``; others untouched.

    Draw ``j`` picks the member at index ``md5(j:seed) mod m`` in key order:
    an equi-join of the draw ids with the indexed members.
    """
    spark = df.sparkSession
    members = df.where(F.col(q(col)) == F.lit(cls))
    indexed = O.with_row_index(members, [key])
    m = members.agg(F.count(F.lit(1)).alias("__m"))
    draws = spark.range(n).withColumnRenamed("id", "__j")
    draws = attach_scalars(draws, m).select(
        F.pmod(hash_int(F.concat(F.col("__j").cast("string"), F.lit(f":{seed}"))), F.col("__m")).alias("__idx"))
    picked = draws.join(indexed, "__idx").drop("__idx")
    rest = df.where(F.col(q(col)).isNull() | (F.col(q(col)) != F.lit(cls)))
    return rest.unionByName(picked.select(*df.columns))


def resample_classes(df: DataFrame, col: str, plan: dict, key: str, seed: int = 10) -> DataFrame:
    """O-06: ``{class: (n, replace)}``; every planned class is resampled, the
    others are kept.  Growing without replacement is refused; ``n`` equal to
    the class size keeps the class as it is."""
    counts = {r[0]: r[1] for r in df.where(F.col(q(col)).isin(list(plan)))
              .groupBy(F.col(q(col))).count().collect()}  # one row per planned class
    parts = [df.where(F.col(q(col)).isNull() | ~F.col(q(col)).isin(list(plan)))]
    for cls, (n, replace) in plan.items():
        members = df.where(F.col(q(col)) == F.lit(cls))
        size = counts.get(cls, 0)
        if n == size:
            parts.append(members)
        elif n < size and not replace:
            parts.append(undersample(members, col, cls, n, key, seed))
        elif replace:
            parts.append(oversample(members, col, cls, n, key, seed))
        else:
            raise ValueError(f"class {cls!r}: {n} > {size} rows needs replacement")
    return reduce(lambda a, b: a.unionByName(b), parts)
