"""Tables behind the charts (C-*).  Drawing is left to the caller.

Every chart table is an aggregate: histograms are a group-by on a computed bin
id, the density curve is one aggregate pass with one accumulator per grid
point (no data × grid product), box statistics are two small aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import attach_scalars, class_share
from .relational import q


def _bin_id(x, lo, hi, bins: int):
    """numpy-style equal-width bin of ``x`` over [lo, hi]; the last bin is closed."""
    width_zero = hi == lo
    raw = F.floor((x - lo) * F.lit(bins) / (hi - lo))
    return F.when(width_zero, F.lit(bins // 2)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")


def _bin_spine(df: DataFrame, bins: int, lo, hi) -> DataFrame:
    spark = df.sparkSession
    return spark.range(bins).select(F.col("id").cast("int").alias("bin"))


def _edges(bins: int):
    lo, hi = F.col("__lo"), F.col("__hi")
    # numpy widens a zero-width range to [x - 0.5, x + 0.5]
    elo = F.when(hi == lo, lo - 0.5).otherwise(lo)
    ehi = F.when(hi == lo, hi + 0.5).otherwise(hi)
    b = F.col("bin")
    return (elo + (ehi - elo) * b / F.lit(bins)).alias("lo"), (elo + (ehi - elo) * (b + 1) / F.lit(bins)).alias("hi")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """C-01: (bin, lo, hi, count) for ``bins`` equal bins over [min, max]."""
    x = F.col(q(col)).cast("double")
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    data = attach_scalars(df.where(x.isNotNull()).select(x.alias("__x")), rng)
    counts = data.groupBy(_bin_id(F.col("__x"), F.col("__lo"), F.col("__hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    spine = attach_scalars(_bin_spine(df, bins, None, None), rng)
    lo, hi = _edges(bins)
    return (spine.join(counts, "bin", "left")
            .select("bin", lo, hi, F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histogram_sum(df: DataFrame, x_col: str, y_cols, bins: int = 10) -> DataFrame:
    """C-06: histogram of ``x`` weighted by the sum of each ``y``."""
    ys = [y_cols] if isinstance(y_cols, str) else list(y_cols)
    x = F.col(q(x_col)).cast("double")
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    data = attach_scalars(df.where(x.isNotNull()), rng)
    sums = data.groupBy(_bin_id(x, F.col("__lo"), F.col("__hi"), bins).alias("bin")).agg(
        *[F.sum(F.col(q(y))).alias(f"sum_{y}") for y in ys])
    spine = attach_scalars(_bin_spine(df, bins, None, None), rng)
    lo, hi = _edges(bins)
    return spine.join(sums, "bin", "left").select("bin", lo, hi, *[
        F.coalesce(F.col(f"sum_{y}"), F.lit(0)).alias(f"sum_{y}") for y in ys])


def kde(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """C-02: Gaussian kernel density on ``points`` grid values over [min, max],
    Scott bandwidth h = std(ddof=1) · n^(-1/5).  Densities are null where the
    bandwidth is 0 or undefined (a constant column, a single row).

    One aggregate pass: accumulator ``k`` sums exp(-(g_k - x)²/(2h²)) over the
    rows, with g_k computed from the attached min/max."""
    x = F.col(q(col)).cast("double")
    stats = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.stddev_samp(x).alias("__sd"),
                   F.count(x).alias("__n"))
    stats = stats.withColumn("__h", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    data = attach_scalars(df.where(x.isNotNull()).select(x.alias("__x")), stats)
    step = (F.col("__hi") - F.col("__lo")) / F.lit(max(points - 1, 1))
    acc = []
    for k in range(points):
        g = F.col("__lo") + step * k
        acc.append(F.sum(F.exp(F.try_divide(-F.pow(g - F.col("__x"), 2), 2 * F.col("__h") * F.col("__h")))).alias(f"__k{k}"))
    sums = data.groupBy("__lo", "__hi", "__h", "__n").agg(*acc)
    norm = F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi))
    rows = [F.struct(F.lit(k).alias("point"), (F.col("__lo") + step * k).alias("x"),
                     F.try_divide(F.col(f"__k{k}"), norm).alias("density")) for k in range(points)]
    return sums.select(F.inline(F.array(*rows)))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """C-03: q1, median, q3, whiskers (extreme points within 1.5 IQR), outliers."""
    x = F.col(q(col)).cast("double")
    from .quantiles import quantile_frame
    p = quantile_frame(df.select(x.alias("x")), ["x"], [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    p = p.select(F.col("x_q1").alias("q1"), F.col("x_median").alias("median"), F.col("x_q3").alias("q3"))
    p = p.withColumn("__lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("__hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = attach_scalars(df.select(x.alias("__x")), p)
    inside = (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))
    return j.groupBy("q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("__x"))).alias("upper_whisker"),
        F.count_if(F.col("__x").isNotNull() & ~inside).cast("long").alias("outliers"))


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """C-04: category, count and percent share (pie / count plot)."""
    return class_share(df, col)


def series(df: DataFrame, x: str, ys) -> DataFrame:
    """C-05: long (x, series, value) rows for bar/line/area charts."""
    ys = [ys] if isinstance(ys, str) else list(ys)
    cast = df.select(F.col(q(x)), *[F.col(q(y)).cast("double").alias(y) for y in ys])
    return cast.unpivot([x], ys, "series", "value")


def pie(df: DataFrame, name: str, value: str) -> DataFrame:
    """C-07: sum of ``value`` per ``name`` and its share in percent (null when the grand total is 0)."""
    sums = df.where(F.col(q(name)).isNotNull()).groupBy(F.col(q(name))).agg(F.sum(F.col(q(value))).alias("total"))
    grand = sums.agg(F.sum("total").alias("__all"))
    return attach_scalars(sums, grand).select(
        F.col(q(name)), "total", F.try_divide(F.col("total") * 100.0, F.col("__all")).alias("percent"))


def points(df: DataFrame, cols, key: str, color: str | None = None, max_rows: int | None = None,
           seed: int = 0) -> DataFrame:
    """C-08: scatter points of every row.  A caller who wants fewer passes
    ``max_rows``: that many rows by hash order of ``key`` (deterministic,
    engine-independent)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    keep = cols + ([color] if color else [])
    if max_rows is None:
        return df.select(F.col(q(key)), *[F.col(q(c)) for c in keep])
    h = F.md5(F.concat(F.col(q(key)).cast("string"), F.lit(f":{seed}")))
    return df.select(F.col(q(key)), *[F.col(q(c)) for c in keep], h.alias("__h")) \
             .orderBy("__h", key).limit(max_rows).drop("__h")


def pair_points(df: DataFrame, cols, key: str, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """C-09: every column pair (a < b) of the rows of ``points``: (key, x_col, y_col, x, y)."""
    cols = list(cols)
    sample = points(df, cols, key, None, max_rows, seed)
    pairs = [F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
                      F.col(q(a)).cast("double").alias("x"), F.col(q(b)).cast("double").alias("y"))
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return sample.select(F.col(q(key)), F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")


def pair_bins(df: DataFrame, cols, bins: int = 20) -> DataFrame:
    """C-09 for large tables: 2-D bin counts per column pair over all rows."""
    cols = list(cols)
    rng = df.agg(*[e for c in cols for e in (F.min(F.col(q(c)).cast("double")).alias(f"__lo_{c}"),
                                             F.max(F.col(q(c)).cast("double")).alias(f"__hi_{c}"))])
    j = attach_scalars(df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols]), rng)
    bid = {c: _bin_id(F.col(q(c)), F.col(f"__lo_{c}"), F.col(f"__hi_{c}"), bins) for c in cols}
    pairs = [F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"), bid[a].alias("x_bin"), bid[b].alias("y_bin"))
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    exploded = j.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").dropna()
    return exploded.groupBy("x_col", "y_col", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


def actual_vs_predicted(pred: DataFrame, order_by, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """C-10: (order, actual, predicted) rows for the comparison chart."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return pred.select(*order, F.col(q(label)).cast("double").alias("actual"),
                       F.col(q(prediction)).cast("double").alias("predicted"))
