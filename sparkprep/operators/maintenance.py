"""Keyed table maintenance (S-21, S-22)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import q


def upsert_latest(target: DataFrame, updates: DataFrame, key, ts: str) -> DataFrame:
    """S-21: one row per key – the newest by ``ts``; on equal ``ts`` the update wins.

    A ``max_by`` aggregate per key (partial aggregation before the shuffle),
    so a key with millions of versions never becomes one big window partition."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = target.columns
    both = (target.withColumn("__prio", F.lit(0))
            .unionByName(updates.select(*cols).withColumn("__prio", F.lit(1))))
    others = [c for c in cols if c not in keys]
    # newest first, then the update, then the row values: a total order, so re-runs agree
    order = F.struct(F.col(q(ts)), F.col("__prio"), *[F.col(q(c)) for c in others])
    latest = both.groupBy(*[F.col(q(k)) for k in keys]).agg(
        F.max_by(F.struct(*[F.col(q(c)) for c in others]), order).alias("__row"))
    return latest.select(*[F.col(q(k)) for k in keys], *[F.col("__row")[c].alias(c) for c in others]) \
                 .select(*[F.col(q(c)) for c in cols])


def delete_where(df: DataFrame, key: str, values) -> DataFrame:
    """S-22: drop rows whose key is in ``values`` (a list or a one-column frame)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("__k")).distinct()
        return df.join(v, F.col(q(key)) == F.col("__k"), "left_anti")
    vals = list(values)
    return df.where(~F.col(q(key)).isin(vals) | F.col(q(key)).isNull())
