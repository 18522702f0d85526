"""Group-by aggregation (A-*).

``group_agg`` compiles a pandas-style ``{column: [function, ...]}`` plan into a
single ``groupBy().agg()``: Spark runs it as a partial (map-side) hash
aggregate followed by a final aggregate after the shuffle, so a hot key only
costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import columns_of_kind, q

# Aggregation names offered by the reference for numeric and
# for categorical columns.
NUMERIC_FUNCTIONS = ("mean", "median", "sum", "min", "max", "count", "std", "var",
                     "first", "last", "nunique", "size")
CATEGORICAL_FUNCTIONS = ("first", "last", "min", "max", "count", "nunique", "size")


def _order_struct(order_by) -> Column:
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    if len(cols) == 1:
        return F.col(q(cols[0]))
    return F.struct(*[F.col(q(c)) for c in cols])


def agg_expr(col: str, fn: str, order_by=None, approx: bool = False) -> Column:
    """One pandas aggregation name → Spark aggregate expression."""
    c = F.col(q(col))
    if fn == "mean":
        return F.avg(c)
    if fn == "median":
        return F.percentile_approx(c, 0.5, 10000) if approx else F.median(c)
    if fn == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn == "count":
        return F.count(c)
    if fn == "size":
        return F.count(F.lit(1))
    if fn == "std":
        return F.stddev_samp(c)
    if fn == "var":
        return F.var_samp(c)
    if fn in ("first", "last"):
        if order_by is None:
            raise ValueError("first/last need an explicit order_by (row order)")
        o = F.when(c.isNotNull(), _order_struct(order_by))
        return F.min_by(c, o) if fn == "first" else F.max_by(c, o)
    if fn == "nunique":
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    raise ValueError(f"unknown aggregation {fn!r}")


def group_agg(df: DataFrame, key, spec: dict, order_by=None, approx: bool = False) -> DataFrame:
    """A-01: ``{col: [fn, ...]}`` per key; outputs ``{col}_{fn}``; null keys dropped.

    An exact ``median`` as an aggregate would keep a value map per group and
    merge it in one task.  Medians therefore come from the distributed selection
    of ``quantiles.grouped_statistics``, whose first scan also computes the other
    aggregates and whose second serves all medians together.
    """
    from .quantiles import grouped_statistics

    keys = [key] if isinstance(key, str) else list(key)
    plan = [(col, fn) for col, fns in spec.items() for fn in ([fns] if isinstance(fns, str) else fns)]
    kept = df.where(" AND ".join(f"{q(k)} IS NOT NULL" for k in keys))
    medians = [] if approx else list(dict.fromkeys(c for c, fn in plan if fn == "median"))
    others = [agg_expr(c, fn, order_by, approx).alias(f"{c}_{fn}") for c, fn in plan if approx or fn != "median"]
    if medians:
        out = grouped_statistics(kept, keys, {c: [(0.5, f"{c}_median")] for c in medians}, others)
    else:
        out = kept.groupBy(*[F.col(q(k)) for k in keys]).agg(*others)
    return out.select(*[F.col(q(k)) for k in keys], *[F.col(q(f"{c}_{fn}")) for c, fn in plan])


def group_agg_all(df: DataFrame, key, fn: str, order_by=None, approx: bool = False) -> DataFrame:
    """A-02: one function over every numeric non-key column."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in columns_of_kind(df, ("numeric",)) if c not in keys]
    return group_agg(df, keys, {c: [fn] for c in cols}, order_by, approx)


def quantile(df: DataFrame, col: str, qs=(0.25, 0.5, 0.75), approx: bool = False) -> DataFrame:
    """A-11: exact linear-interpolation quantiles as one row (``q25``, ``q50`` ...)."""
    names = [f"q{int(round(p * 100))}" for p in qs]
    if approx:
        return df.agg(*[F.percentile_approx(F.col(q(col)), p, 10000).alias(nm) for p, nm in zip(qs, names)])
    from .quantiles import quantile_frame
    frame = quantile_frame(df.select(F.col(q(col)).alias("x")), ["x"], list(qs), names)
    return frame.select(*[F.col(f"x_{nm}").alias(nm) for nm in names])
