"""Null handling (N-*).

Statistic fills compute their statistics in one aggregate (a one-row frame)
that is attached to every row by a broadcast equi-join on a constant key;
ordered fills use the bucket/carry plan from ``plans.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ordered as O
from .profile import attach_scalars
from .relational import kind_of, q

NUMERIC_FILLS = ("0", "ffill", "bfill", "mean", "median", "min", "max")
STRING_FILLS = ("ffill", "bfill", "mode", "antimode")


def fill_value(df: DataFrame, value, cols=None) -> DataFrame:
    """N-01 / N-10: constant fill; only columns whose type fits the value."""
    if cols is None:
        return df.na.fill(value)
    return df.na.fill(value, subset=list(cols))


def ffill(df: DataFrame, cols, order_by, partition_by=None, n_buckets=None) -> DataFrame:
    """N-02: forward fill in row order (per series when ``partition_by`` is given)."""
    return O.fill(df, cols, order_by, partition_by, "forward", n_buckets)


def bfill(df: DataFrame, cols, order_by, partition_by=None, n_buckets=None) -> DataFrame:
    """N-03: backward fill."""
    return O.fill(df, cols, order_by, partition_by, "backward", n_buckets)


def _stat_expr(col: str, method: str):
    c = F.col(q(col))
    return {"mean": F.avg(c), "median": F.median(c), "min": F.min(c), "max": F.max(c)}[method]


def _mode_frame(df: DataFrame, col: str, least: bool, alias: str) -> DataFrame:
    counts = df.where(F.col(q(col)).isNotNull()).groupBy(F.col(q(col)).alias("__v")).count()
    order = F.col("count").asc() if least else F.col("count").desc()
    return counts.orderBy(order, F.col("__v").asc()).limit(1).select(F.col("__v").alias(alias))


def fill_plan(df: DataFrame, plan, order_by=None, partition_by=None) -> DataFrame:
    """N-11: apply ``[(column, method), ...]`` in order.

    ``method`` ∈ {'0', 'ffill', 'bfill', 'mean', 'median', 'min', 'max', 'mode',
    'antimode'} or ``('value', x)``.  Consecutive statistic fills share one
    aggregate pass; ordered fills need ``order_by``.
    """
    out = df
    pending = []  # statistic fills computed on the frame as it is at that point

    def flush(frame, items):
        if not items:
            return frame
        aggs = [(_stat_expr(c, m)).alias(f"__s{i}") for i, (c, m) in enumerate(items)
                if m in ("mean", "min", "max")]
        stats = frame.agg(*aggs) if aggs else None
        medians = [(i, c) for i, (c, m) in enumerate(items) if m == "median"]
        if medians:
            from .quantiles import quantile_frame
            qf = quantile_frame(frame.select(*[F.col(q(c)).alias(f"m{i}") for i, c in medians]),
                                [f"m{i}" for i, _ in medians], [0.5], ["med"])
            qf = qf.select(*[F.col(f"m{i}_med").alias(f"__s{i}") for i, _ in medians])
            stats = qf if stats is None else attach_scalars(stats, qf)
        modes = [(i, c, m) for i, (c, m) in enumerate(items) if m in ("mode", "antimode")]
        joined = frame
        if stats is not None:
            joined = attach_scalars(joined, stats)
        for i, c, m in modes:
            joined = attach_scalars(joined, _mode_frame(frame, c, m == "antimode", f"__s{i}"))
        repl = {}
        for i, (c, m) in enumerate(items):
            target = frame.schema[c].dataType
            repl[c] = F.coalesce(F.col(q(c)), F.col(f"__s{i}").cast(target)).alias(c)
        return joined.select(*[repl.get(c, F.col(q(c))) for c in frame.columns])

    for col, method in plan:
        if method in ("mean", "median", "min", "max", "mode", "antimode"):
            if any(c == col for c, _ in pending):
                out = flush(out, pending)
                pending = []
            pending.append((col, method))
            continue
        out = flush(out, pending)
        pending = []
        if method in ("0", 0):
            out = out.na.fill(0, subset=[col])
        elif method in ("ffill", "bfill"):
            if order_by is None:
                raise ValueError("ffill/bfill need order_by")
            out = O.fill(out, [col], order_by, partition_by, "forward" if method == "ffill" else "backward")
        elif isinstance(method, tuple) and method[0] == "value":
            out = out.na.fill(method[1], subset=[col])
        else:
            raise ValueError(f"unknown fill method {method!r}")
    return flush(out, pending)


def fill_stat(df: DataFrame, col: str, method: str) -> DataFrame:
    """N-04 .. N-09: fill one column with its mean/median/min/max/mode/antimode."""
    return fill_plan(df, [(col, method)])


def impute_for_model(df: DataFrame, order_by, cols=None, partition_by=None) -> DataFrame:
    """N-12: forward fill then backward fill every (or the given) column."""
    keys = set([partition_by] if isinstance(partition_by, str) else (partition_by or []))
    order = set([order_by] if isinstance(order_by, str) else order_by)
    cols = cols or [c for c in df.columns if c not in keys and c not in order]
    return O.fill(df, cols, order_by, partition_by, "both")


def dropna(df: DataFrame, cols=None) -> DataFrame:
    """N-13: drop rows holding any null (in ``cols`` when given)."""
    return df.na.drop(how="any", subset=cols)
