"""Projection, filter, join, union, duplicate and sort operators (P-*, J-*, U-*).

Every function returns a lazily planned DataFrame; Catalyst prunes columns and
pushes predicates into the Parquet scan.  pandas null rules are made explicit:
``==``/``<`` with a null are false, ``!=`` with a null is true, merge keys
match null to null, group keys drop nulls.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "timedelta"
    return "other"


def q(name: str) -> str:
    """Back-quote a column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


# ---- projection ------------------------------------------------------------

def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P-01."""
    return df.drop(*cols)


def columns_of_kind(df: DataFrame, include=("numeric",), exclude=()) -> list[str]:
    """P-02: column names by kind (numeric / string / datetime / bool)."""
    inc, exc = set(include or ()), set(exclude or ())
    out = []
    for f in df.schema.fields:
        k = kind_of(f.dataType)
        if (not inc or k in inc) and k not in exc:
            out.append(f.name)
    return out


def select_kind(df: DataFrame, include=("numeric",), exclude=()) -> DataFrame:
    return df.select(*[F.col(q(c)) for c in columns_of_kind(df, include, exclude)])


def drop_datetime(df: DataFrame) -> DataFrame:
    """P-09: remove datetime columns from a feature frame."""
    return df.drop(*columns_of_kind(df, include=("datetime",)))


def round_numeric(df: DataFrame, k: int = 2) -> DataFrame:
    """P-08: round fractional numerics to ``k`` digits (integers untouched)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            exprs.append(F.round(F.col(q(f.name)), k).alias(f.name))
        else:
            exprs.append(F.col(q(f.name)))
    return df.select(*exprs)


def preview(df: DataFrame, n: int = 50, order_by=None) -> DataFrame:
    """P-06: first ``n`` rows in a stated order (TakeOrderedAndProject)."""
    order_by = order_by or df.columns
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, n: int, order_by) -> DataFrame:
    """P-07: last ``n`` rows by ``order_by``, returned in ascending order."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.col(c).desc() for c in cols]).limit(n).orderBy(*cols)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """P-05: values offered by the filter picker (nulls excluded)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


# ---- filter (P-03 / P-04) -------------------------------------------------

# The comparison operators offered by the reference.
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")


def _literal_sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return repr(value) + "D"  # a double literal: compares with double columns without casts
    if isinstance(value, int):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def condition_sql(col: str, op: str, value) -> str:
    """One condition as SQL with pandas null rules (never null itself).

    Written as ``c IS NOT NULL AND c > v`` / ``c IS NULL OR c <> v`` rather
    than ``coalesce(...)`` so the parts reach the Parquet scan as pushed
    filters; under ``NOT`` the result is still the pandas one."""
    c, v = q(col), _literal_sql(value)
    if value is None:
        return f"({c} IS NULL)" if op == "==" else (f"({c} IS NOT NULL)" if op == "!=" else "false")
    if op == "==":
        return f"({c} IS NOT NULL AND {c} = {v})"
    if op == "!=":
        return f"({c} IS NULL OR {c} <> {v})"
    if op in (">", "<", ">=", "<="):
        return f"({c} IS NOT NULL AND {c} {op} {v})"
    raise ValueError(f"unknown comparison {op!r}")


_REF = re.compile(r"\b[cC]\d+\b|[&|~]")
_LOGIC = {"&": " AND ", "|": " OR ", "~": " NOT "}


def combine_sql(conditions: dict, combine: str) -> str:
    """Substitute ``c1``..``cn`` in a boolean text such as ``c1 & (c2 | ~c3)``.

    One pass over the combine text: values and column names that hold ``&``,
    ``|`` or ``~`` themselves are never rewritten."""
    def sub(m):
        key = m.group(0)
        if key in _LOGIC:
            return _LOGIC[key]
        if key not in conditions:
            raise KeyError(f"condition {key} is not defined")
        col, op, value = conditions[key]
        return "(" + condition_sql(col, op, value) + ")"

    return _REF.sub(sub, combine)


def filter_conditions(df: DataFrame, conditions: dict, combine: str | None = None) -> DataFrame:
    """P-03: keep rows where the combined named conditions hold."""
    combine = combine or " & ".join(conditions)
    return df.where(F.expr(combine_sql(conditions, combine)))


# ---- joins (J-*) -----------------------------------------------------------

def merge(left: DataFrame, right: DataFrame, left_on, right_on=None, how: str = "inner",
          suffixes=("_x", "_y")) -> DataFrame:
    """J-01..J-05: pandas-style merge.

    * same-named keys come out once (coalesced for outer joins);
    * differently named keys are both kept;
    * other clashing names get ``_x`` / ``_y``;
    * null keys match null keys (``<=>``), spread over as many parts as others.
    """
    lkeys = [left_on] if isinstance(left_on, str) else list(left_on)
    rkeys = lkeys if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    how = {"outer": "full", "full_outer": "full"}.get(how, how)
    shared_keys = {lk for lk, rk in zip(lkeys, rkeys) if lk == rk}
    lcols, rcols = left.columns, right.columns
    clash = (set(lcols) & set(rcols)) - shared_keys

    left, right = _null_keys_spread(left, right, lkeys, rkeys)
    l = left.alias("__l")
    r = right.alias("__r")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"__l.{q(lk)}").eqNullSafe(F.col(f"__r.{q(rk)}")) for lk, rk in zip(lkeys, rkeys)])
    joined = l.join(r, cond & (F.col("__l.__salt") == F.col("__r.__salt")), how)
    if how in ("right", "full"):  # a copy in a part without a partner is no row of the result; the others have theirs
        joined = joined.where(F.col("__l.__salt").isNotNull() | ~F.coalesce(F.col("__r.__copied"), F.lit(False)))

    out = []
    for c in lcols:
        lc = F.col(f"__l.{q(c)}")
        if c in shared_keys:
            rk_col = F.col(f"__r.{q(c)}")
            if how in ("right",):
                out.append(rk_col.alias(c))
            elif how == "full":
                # a null key on one side still pairs with a null key on the other;
                # otherwise take the side that exists
                out.append(F.coalesce(lc, rk_col).alias(c))
            else:
                out.append(lc.alias(c))
        elif c in clash:
            out.append(lc.alias(c + suffixes[0]))
        else:
            out.append(lc.alias(c))
    for c in rcols:
        if c in shared_keys:
            continue
        rc = F.col(f"__r.{q(c)}")
        out.append(rc.alias(c + suffixes[1]) if c in clash else rc.alias(c))
    return joined.select(*out)


def _null_keys_spread(left: DataFrame, right: DataFrame, lkeys, rkeys) -> tuple:
    """Both sides with ``__salt``: rows whose keys are all null would meet in one task; those of the left are dealt to parts, and
    those of the right are copied to every part (``__copied``), or dealt like them where the left has none.

    There are at most as many parts as such rows on the left, so copies never outnumber the pairs."""
    most = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lnull, rnull = (reduce(lambda a, b: a & b, [F.col(q(k)).isNull() for k in keys]) for keys in (lkeys, rkeys))
    parts = left.where(lnull).agg(F.least(F.count("*"), F.lit(most)).cast("int")).scalar()

    def dealt(df, n):
        plain = [F.col(q(f.name)) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        return F.pmod(F.xxhash64(*plain), n).cast("int")

    l = left.withColumn("__salt", F.when(lnull, dealt(left, F.greatest(parts, F.lit(1)))).otherwise(F.lit(0)))
    r = right.withColumn("__parts", parts).withColumn("__copied", rnull & (F.col("__parts") > 0))
    copies = F.when(F.col("__copied"), F.sequence(F.lit(0), F.greatest("__parts", F.lit(1)) - 1)).when(
        rnull, F.array(dealt(right, F.lit(most)))).otherwise(F.array(F.lit(0)))
    return l, r.withColumn("__salt", F.explode(copies)).drop("__parts")


def drop_rows(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """J-06: remove rows whose key occurs in ``other`` (null-safe anti join)."""
    keys = [key] if isinstance(key, str) else list(key)
    o = other.select(*[F.col(q(k)).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    cond = reduce(lambda a, b: a & b, [df[q(k)].eqNullSafe(o[f"__k{i}"]) for i, k in enumerate(keys)])
    return df.join(o, cond, "left_anti")


# ---- union / duplicates / order (U-*) --------------------------------------

def concat(dfs) -> DataFrame:
    """U-01: stack by column name; missing columns → null; first-seen order."""
    dfs = list(dfs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def duplicate_count(df: DataFrame) -> DataFrame:
    """U-02: rows beyond the first occurrence (nulls equal), as one row."""
    g = df.groupBy(*[F.col(q(c)) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """U-03: every row that has a twin (``keep=False``).

    Duplicate groups are found with a (partially pre-aggregated) group-by and
    joined back null-safely; a hot duplicated row costs one row on the build
    side, never a single huge window partition.
    """
    cols = df.columns
    dups = (df.groupBy(*[F.col(q(c)) for c in cols]).count().where("count > 1")
            .select(*[F.col(q(c)).alias(f"__d{i}") for i, c in enumerate(cols)]))
    cond = reduce(lambda a, b: a & b, [df[q(c)].eqNullSafe(dups[f"__d{i}"]) for i, c in enumerate(cols)])
    return df.join(dups, cond, "left_semi")


def drop_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """U-04."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def sort_by(df: DataFrame, cols, ascending=True) -> DataFrame:
    """U-05: global sort (range-partitioned)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.orderBy(*cols, ascending=ascending)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """U-06: (value, count) for non-null values, most frequent first."""
    return (df.where(F.col(q(col)).isNotNull()).groupBy(F.col(q(col))).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(q(col)).asc()))


def mode_value(df: DataFrame, col: str, least: bool = False) -> DataFrame:
    """U-07: most (or least) frequent non-null value; ties → smallest value."""
    counts = df.where(F.col(q(col)).isNotNull()).groupBy(F.col(q(col)).alias("value")).count()
    order = F.col("count").asc() if least else F.col("count").desc()
    return counts.orderBy(order, F.col("value").asc()).limit(1)

