"""Row-ordered window operators (E-13, E-14, W-01 .. W-04, W-08, W-15).

All of them run on the halo-chunk plan of ``plans.ordered``: a global row
index in ``(partition_by, order_by)`` order, chunks of consecutive indices
with the frame's reach copied across chunk edges, and ordinary Spark windows
per ``(chunk, series key)``.  No window ever holds a whole table or a whole
(possibly hot) series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ordered as O
from .relational import q

# Rolling functions offered by the reference.
ROLLING_FUNCTIONS = ("min", "max", "mean", "median", "sum", "count", "std", "var")


def centred_frame(window: int) -> tuple[int, int]:
    """pandas ``center=True`` frame for ``window`` rows: [-(w//2), +((w-1)//2)]."""
    return window // 2, (window - 1) // 2


def _median_of(arr: Column) -> Column:
    s = F.sort_array(arr)
    n = F.size(s)
    mid_hi = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    mid_lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (mid_lo.cast("double") + mid_hi.cast("double")) / 2)


def rolling_expr(col: str, fn: str, frame, min_periods: int) -> Column:
    x = F.col(q(col))
    non_null = F.count(x).over(frame)
    if fn == "count":
        rows = F.count(F.lit(1)).over(frame)
        return F.when(rows >= min_periods, non_null.cast("double"))
    aggs = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}
    if fn == "median":
        out = _median_of(F.collect_list(x).over(frame))
    elif fn in aggs:
        out = aggs[fn](x).over(frame)
        if fn == "sum":  # pandas: an all-null window sums to 0 when min_periods allows it
            out = F.coalesce(out, F.lit(0))
    else:
        raise ValueError(f"unknown rolling function {fn!r}")
    return F.when(non_null >= F.lit(max(min_periods, 0)), out.cast("double"))


def rolling(df: DataFrame, col: str, window: int, fn="mean", min_periods: int | None = None,
            center: bool = False, order_by=None, partition_by=None, chunk_rows: int | None = None) -> DataFrame:
    """W-01 .. W-04: ``{col}_{fn}_rolling`` over ``window`` rows (pandas rules:
    ``min_periods`` defaults to ``window``; the result needs that many
    non-null values, ``count`` gates on rows)."""
    if order_by is None:
        raise ValueError("rolling needs order_by (the row order)")
    fns = [fn] if isinstance(fn, str) else list(fn)
    mp = window if min_periods is None else min_periods
    before, after = centred_frame(window) if center else (window - 1, 0)

    def compute(w):
        frame = w.rowsBetween(-before, after)
        return {f"{col}_{f}_rolling": rolling_expr(col, f, frame, mp) for f in fns}

    out = O.halo_window(df, order_by, partition_by, before, after, compute, chunk_rows)
    return out.drop("__idx")


def shift(df: DataFrame, col: str, periods: int = 1, order_by=None, partition_by=None,
          chunk_rows: int | None = None) -> DataFrame:
    """E-13: ``{col}_shifted_{n}`` = value ``n`` rows earlier (``n`` < 0: later)."""
    n = periods
    before, after = (n, 0) if n >= 0 else (0, -n)

    def compute(w):
        e = F.lag(F.col(q(col)), n).over(w) if n >= 0 else F.lead(F.col(q(col)), -n).over(w)
        return {f"{col}_shifted_{n}": e}

    return O.halo_window(df, order_by, partition_by, before, after, compute, chunk_rows).drop("__idx")


def diff(df: DataFrame, col: str, periods: int = 1, order_by=None, partition_by=None,
         chunk_rows: int | None = None) -> DataFrame:
    """E-14: ``{col}_diff`` = value minus the value ``n`` rows earlier."""
    n = periods
    before, after = (n, 0) if n >= 0 else (0, -n)

    def compute(w):
        prev = F.lag(F.col(q(col)), n).over(w) if n >= 0 else F.lead(F.col(q(col)), -n).over(w)
        return {f"{col}_diff": F.col(q(col)) - prev}

    return O.halo_window(df, order_by, partition_by, before, after, compute, chunk_rows).drop("__idx")


def sequence_windows(df: DataFrame, col: str, length: int, order_by=None, partition_by=None,
                     chunk_rows: int | None = None) -> DataFrame:
    """W-15: for each row with ``length`` earlier values: ``window`` (those
    values, oldest first) and ``target`` (the row's value)."""
    def compute(w):
        return {"window": F.collect_list(F.col(q(col)).cast("double")).over(w.rowsBetween(-length, -1))}

    out = O.halo_window(df, order_by, partition_by, length, 0, compute, chunk_rows)
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return (out.where(F.size("window") == length)
            .select(*keys, *order, "window", F.col(q(col)).cast("double").alias("target")))


def time_split(df: DataFrame, order_by, test_size: float = 0.2, partition_by=None) -> DataFrame:
    """W-08: first ``int(n·(1−test_size))`` rows in time order are train, the
    rest test; adds ``split`` ('train' / 'test').  Per series with keys."""
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    joined = O.series_index(df, order_by, keys, name="__pos", size_name="__n")
    cut = F.floor(F.col("__n") * F.lit(1.0 - test_size))
    return (joined.withColumn("split", F.when(F.col("__pos") < cut, F.lit("train")).otherwise(F.lit("test")))
            .drop("__pos", "__n"))
