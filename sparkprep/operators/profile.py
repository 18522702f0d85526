"""Table profile and statistics (D-*).

Whole-table statistics are computed in one aggregate pass and turned into rows
with ``inline(array(struct ...))`` on the one-row result, so nothing but a
handful of numbers per column reaches the driver.  Distinct counts meet by
(column, value), and where only few levels matter, a pass of sketches first
rules out the columns that have many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import columns_of_kind, kind_of, q


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row of ``df``.

    An equi-join on a constant key against a broadcast one-row build side
    (size bound: exactly one row), instead of a cartesian product.
    """
    return (df.withColumn("__one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one")
            .drop("__one"))


def _values(df: DataFrame, cols) -> DataFrame:
    """(i, v): the non-null values of column number i as text, one row a value."""
    def text(c):
        x, kind = F.col(q(c)), df.schema[c].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (x + F.lit(0.0)).cast("string")  # one zero
        if isinstance(kind, T.BinaryType):
            return F.hex(x)
        return F.to_json(x) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else x.cast("string")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(cols)])
    return df.select(F.explode(pairs).alias("s")).select("s.i", "s.v").where("v IS NOT NULL")


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """(i, n): exact number of different values of each column, a column without any absent.

    Values meet by (column, value): a partial aggregate on every task, and no column's values in one place."""
    return _values(df, cols).groupBy("i", "v").agg(F.lit(1)).groupBy("i").agg(F.count(F.lit(1)).alias("n"))


def few_levels(df: DataFrame, cols, cap: int) -> tuple[int, dict]:
    """(rows, {column: exact number of different non-null values}) of the columns with at most ``cap``.

    A first pass of mergeable sketches rules out the columns with many more, so
    the exact pass keeps a bounded number of values a column on every task."""
    cols = list(cols)
    sketch = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col(q(c))).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    # the sketch errs by a few percent; anything at most twice the cap is counted exactly
    near = [c for i, c in enumerate(cols) if sketch[f"a{i}"] <= 2 * cap + 2]
    if not near or not sketch["n"]:
        return sketch["n"], {}
    got = {near[r["i"]]: r["n"] for r in distinct_counts(df, near).collect()}  # one row a column
    return sketch["n"], {c: got.get(c, 0) for c in near if got.get(c, 0) <= cap}


def categorical_columns(df: DataFrame, threshold: float = 0.03, max_levels: int = 30) -> list[str]:
    """D-02: distinct/rows < threshold and 1 < distinct <= max_levels."""
    n, levels = few_levels(df, df.columns, max_levels)
    return [c for c in df.columns if levels.get(c, 0) > 1 and levels[c] / n < threshold]


def _levels_table(df: DataFrame, rows: list) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "column string, levels long")


def categorical_table(df: DataFrame, threshold: float = 0.03, max_levels: int = 30) -> DataFrame:
    """D-02 as a table: (column, levels) for the categorical columns."""
    n, levels = few_levels(df, df.columns, max_levels)
    return _levels_table(df, [(c, k) for c, k in levels.items() if k > 1 and k / n < threshold])


def profile(df: DataFrame, threshold: float = 0.03, max_levels: int = 30) -> DataFrame:
    """D-01: one row per column: name, dtype, non-null count, null %, categorical."""
    cats = set(categorical_columns(df, threshold, max_levels))
    stats = df.agg(F.count(F.lit(1)).alias("__n"),
                   *[F.count(F.col(q(c))).alias(f"__c{i}") for i, c in enumerate(df.columns)])
    rows = []
    for i, f in enumerate(df.schema.fields):
        nn = F.col(f"__c{i}")
        frac = F.when(F.col("__n") > 0, F.round(1 - nn / F.col("__n"), 1)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(f.name).alias("column"),
                             F.lit(f.dataType.simpleString()).alias("dtype"),
                             nn.cast("long").alias("non_null"),
                             F.round(frac * 100, 1).alias("null_pct"),
                             F.lit("Yes" if f.name in cats else "No").alias("categorical")))
    return stats.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, cols=None) -> DataFrame:
    """D-03: count, mean, std, min, 25%, 50%, 75%, max per numeric column.

    Output rows are statistics (column ``statistic``), one column per input
    numeric column, like ``pandas.DataFrame.describe``.
    """
    from .quantiles import quantile_frame
    cols = cols or columns_of_kind(df, ("numeric",))
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        aggs += [F.count(x).cast("double").alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"),
                 F.stddev_samp(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    pos = df.select(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    pct = quantile_frame(pos, [f"c{i}" for i in range(len(cols))], [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    one = attach_scalars(df.agg(*aggs), pct)
    stats = [("count", lambda i: F.col(f"count_{i}")), ("mean", lambda i: F.col(f"mean_{i}")),
             ("std", lambda i: F.col(f"std_{i}")), ("min", lambda i: F.col(f"min_{i}")),
             ("25%", lambda i: F.col(f"c{i}_p25")), ("50%", lambda i: F.col(f"c{i}_p50")),
             ("75%", lambda i: F.col(f"c{i}_p75")), ("max", lambda i: F.col(f"max_{i}"))]
    rows = [F.struct(F.lit(name).alias("statistic"), *[fn(i).alias(c) for i, c in enumerate(cols)])
            for name, fn in stats]
    return one.select(F.inline(F.array(*rows)))


def describe_datetimes(df: DataFrame, cols=None) -> DataFrame:
    """D-03 for datetime columns: (column, count, mean, min, p25, p50, p75, max), exact, to the second."""
    from .quantiles import quantile_frame
    cols = cols or columns_of_kind(df, ("datetime",))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count long, " + ", ".join(
            f"{c} timestamp_ntz" for c in ("mean", "min", "p25", "p50", "p75", "max")))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = df.select(*[F.when(F.col(q(c)).isNotNull(), F.timestamp_diff("MICROSECOND", start, F.col(q(c)).cast("timestamp_ntz")) / 1e6).alias(f"c{i}")
                          for i, c in enumerate(cols)])
    names = [f"c{i}" for i in range(len(cols))]
    one = attach_scalars(seconds.agg(*[x for c in names for x in (F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"),
                                                                  F.max(c).alias(f"{c}_max"))]),
                         quantile_frame(seconds, names, [0.25, 0.5, 0.75], ["p25", "p50", "p75"]))

    def moment(x):
        return F.timestamp_add("SECOND", F.round(x).cast("long"), start)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}_count").alias("count"), *[moment(F.col(f"c{i}_{s}")).alias(s) for s in (
        "mean", "min", "p25", "p50", "p75", "max")]) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def null_columns(df: DataFrame) -> DataFrame:
    """D-04: (column, null_count) for columns holding at least one null."""
    one = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("long").alias("null_count"))
            for i, c in enumerate(df.columns)]
    return one.select(F.inline(F.array(*rows))).where("null_count > 0")


def _imbalance(df: DataFrame, max_levels: int) -> list:
    cols = columns_of_kind(df, ("string",))
    if not cols:
        return []
    _, levels = few_levels(df, cols, max_levels)
    nulls = df.agg(*[F.max(F.col(q(c)).isNull().cast("int")).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    levels = [(c, levels[c] + (nulls[f"h{i}"] or 0)) for i, c in enumerate(cols) if c in levels]
    return [(c, k) for c, k in levels if k <= max_levels]


def imbalance_columns(df: DataFrame, max_levels: int = 10) -> list[str]:
    """D-05: string columns with at most ``max_levels`` distinct values, null counted."""
    return [c for c, _ in _imbalance(df, max_levels)]


def imbalance_table(df: DataFrame, max_levels: int = 10) -> DataFrame:
    """D-05 as a table: (column, levels) where levels counts null as a level."""
    return _levels_table(df, _imbalance(df, max_levels))


def is_multiclass(df: DataFrame, col: str) -> DataFrame:
    """D-07: number of classes and whether it differs from two."""
    return df.agg(F.count_distinct(F.col(q(col))).cast("long").alias("n_classes")) \
             .withColumn("multiclass", F.col("n_classes") != 2)


def feature_profile(df: DataFrame, cols) -> DataFrame:
    """D-08: per feature its kind, numeric range and distinct count.

    The categorical value lists live in ``feature_values`` (a distributed
    table), so no unbounded list is ever built in one row.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs, rows = [], []
    for i, c in enumerate(cols):
        x = F.col(q(c))
        numeric = kind_of(fields[c]) == "numeric"
        lo = F.min(x).cast("double") if numeric else F.lit(None).cast("double")
        hi = F.max(x).cast("double") if numeric else F.lit(None).cast("double")
        aggs += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}")]
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"),
                             F.lit("numeric" if numeric else "categorical").alias("kind"),
                             F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")))
    ranges = df.agg(F.count(F.lit(1)), *aggs).select(F.inline(F.array(*rows)))
    return (ranges.join(distinct_counts(df, cols), "i", "left").drop("i")
            .withColumn("n_distinct", F.coalesce(F.col("n"), F.lit(0)).cast("long")).drop("n"))


def feature_values(df: DataFrame, cols) -> DataFrame:
    """D-08 (categorical part): every (feature, value) seen in training, distributed."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in cols if kind_of(fields[c]) != "numeric"]
    if not cats:
        return df.sparkSession.createDataFrame([], "feature string, value string")
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(q(c)).cast("string").alias("value")) for c in cats
    ])).alias("fv")).select("fv.*")
    return stacked.where(F.col("value").isNotNull()).distinct()


def correlation(df: DataFrame, cols=None, dummies=()) -> DataFrame:
    """D-09: Pearson, pairwise-complete, as long rows (column, other, corr).

    Each of the categorical columns ``dummies`` takes part as one indicator a level, ``{col}_{level}``."""
    cols = list(cols or columns_of_kind(df, ("numeric",)))
    if dummies:
        from .features import one_hot
        before = set(df.columns)
        for c in dummies:
            df = one_hot(df, c, drop_first=False)
        cols += [c for c in df.columns if c not in before]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = df.agg(*[F.corr(F.col(q(cols[i])).cast("double"), F.col(q(cols[j])).cast("double")).alias(f"r{i}_{j}")
                   for i, j in pairs]) if pairs else df.limit(1).select(F.lit(1).alias("__x"))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = F.lit(1.0)
            else:
                v = F.col(f"r{min(i, j)}_{max(i, j)}")
            rows.append(F.struct(F.lit(a).alias("column"), F.lit(b).alias("other"), v.alias("corr")))
    return one.select(F.inline(F.array(*rows)))


def class_share(df: DataFrame, col: str) -> DataFrame:
    """D-10 / C-04: per class count and percent; long labels shortened."""
    from ..functions.scalar import truncate_label
    counts = df.where(F.col(q(col)).isNotNull()).groupBy(F.col(q(col)).alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__total"))
    return (attach_scalars(counts, total)
            .select("class", truncate_label("class").alias("label"), "count",
                    F.round(F.col("count") * 100.0 / F.col("__total"), 2).alias("percent")))


def class_table(df: DataFrame, col: str) -> DataFrame:
    """D-11: class, count and the share of its rows holding any null (in %)."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(q(c)).isNull()
    return (df.where(F.col(q(col)).isNotNull()).groupBy(F.col(q(col)).alias("class"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.round(F.avg(any_null.cast("double")) * 100, 1).alias("null_pct")))
