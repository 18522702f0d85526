"""Encoders and scalers (E-01 .. E-07).

Level tables (distinct values) are built and numbered on Spark – the code of
a level is its position in sorted order from the distributed row index, never
a driver-side dictionary – and joined back; AQE broadcasts them when small.
Scaler statistics come from one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ordered as O
from .profile import attach_scalars
from .relational import columns_of_kind, q


def levels(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null levels with their 0-based code (``level``, ``code``)."""
    d = df.select(F.col(q(col)).alias("level")).where(F.col("level").isNotNull()).distinct()
    return O.with_row_index(d, ["level"], name="code")


def label_encode(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """E-01: ``{col}_encoded`` = position of the value in sorted order.

    Returns the encoded frame and the mapping table (level, code).
    """
    mapping = levels(df, col)
    m = mapping.select(F.col("level").alias("__lvl"), F.col("code").alias(f"{col}_encoded"))
    out = df.join(m, F.col(q(col)) == F.col("__lvl"), "left").drop("__lvl")
    return out, mapping


def ordinal_encode(df: DataFrame, col: str, classes) -> DataFrame:
    """E-02: first listed class → n, ..., last → 1; unlisted values → null."""
    n = len(classes)
    pairs = []
    for i, c in enumerate(classes):
        pairs += [F.lit(c), F.lit(n - i)]
    mapping = F.create_map(*pairs)
    return df.withColumn(f"{col}_encoded", mapping[F.col(q(col))].cast("long"))


def one_hot(df: DataFrame, col: str, drop_first: bool = True, levels_list=None, max_levels: int | None = None) -> DataFrame:
    """E-03 / E-04: int64 indicator per sorted level, ``{col}_{level}``; the
    source column is removed; null rows get all zeros.

    The level list becomes the output schema, so it is read once on the driver,
    unless the caller passes it.  A caller who wants a guard against keys with
    very many values sets ``max_levels``; more levels then raise."""
    if levels_list is None:
        lv = levels(df, col).orderBy("code").select("level")
        levels_list = [r[0] for r in (lv if max_levels is None else lv.limit(max_levels + 1)).collect()]
        if max_levels is not None and len(levels_list) > max_levels:
            raise ValueError(f"{col}: more than {max_levels} levels")
    use = levels_list[1:] if drop_first else levels_list
    src = F.col(q(col))
    new = [F.coalesce((src == F.lit(v)).cast("long"), F.lit(0).cast("long")).alias(f"{col}_{v}") for v in use]
    keep = [F.col(q(c)) for c in df.columns if c != col]
    return df.select(*keep, *new)


def _stats(col: str, kind: str, i: int) -> list[Column]:
    x = F.col(q(col)).cast("double")
    if kind == "standard":
        return [F.avg(x).alias(f"__c{i}"), F.stddev_pop(x).alias(f"__s{i}")]
    if kind == "minmax":
        return [F.min(x).alias(f"__c{i}"), (F.max(x) - F.min(x)).alias(f"__s{i}")]
    raise ValueError(f"unknown scaling {kind!r}")


def scale(df: DataFrame, kind: str = "standard", cols=None, in_place: bool | None = None) -> DataFrame:
    """E-05 .. E-07: standard (population std), min-max, robust scaling.

    Every scaler is ``(x - centre) / spread`` with centre/spread = mean/std,
    min/range, median/IQR; a zero spread divides by 1 (constant → 0) like
    scikit-learn.  With named columns the result is added as ``{col}_scaled``;
    with none every numeric column is scaled in place ("entire table").
    """
    if cols is None:
        cols = columns_of_kind(df, ("numeric",))
        in_place = True if in_place is None else in_place
    else:
        cols = [cols] if isinstance(cols, str) else list(cols)
        in_place = False if in_place is None else in_place
    if kind == "robust":
        from .quantiles import quantile_frame
        qf = quantile_frame(df.select(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(cols)]),
                            [f"c{i}" for i in range(len(cols))], [0.25, 0.5, 0.75], ["q1", "med", "q3"])
        stats = qf.select(*[e for i in range(len(cols)) for e in
                            (F.col(f"c{i}_med").alias(f"__c{i}"), (F.col(f"c{i}_q3") - F.col(f"c{i}_q1")).alias(f"__s{i}"))])
    else:
        stats = df.agg(*[e for i, c in enumerate(cols) for e in _stats(c, kind, i)])
    joined = attach_scalars(df, stats)
    exprs = {}
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        centre, spread = F.col(f"__c{i}"), F.col(f"__s{i}")
        exprs[c] = F.when(spread != 0, (x - centre) / spread).otherwise(x - centre)
    out = [exprs[c].alias(c) if (c in exprs and in_place) else F.col(q(c)) for c in df.columns]
    if not in_place:
        out += [exprs[c].alias(f"{c}_scaled") for c in cols]
    return joined.select(*out)
