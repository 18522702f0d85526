"""Scalar feature functions (E-08 .. E-12, E-15, E-16) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The trigonometric function names offered by the reference.
TRIG_FUNCTIONS = ("sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh")

_TRIG = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}


def trig(df: DataFrame, col: str, fns=TRIG_FUNCTIONS) -> DataFrame:
    """E-08: adds ``{col}_{fn}``; out-of-domain arcs give NaN like numpy."""
    return df.withColumns({f"{col}_{fn}": _TRIG[fn](F.col(col).cast("double")) for fn in fns})


def power(df: DataFrame, col: str, p: float) -> DataFrame:
    """E-09: ``{col}^{p}``."""
    return df.withColumn(f"{col}^{float(p)}", F.pow(F.col(col).cast("double"), F.lit(float(p))))


def logarithm(df: DataFrame, col: str, kind: str = "e") -> DataFrame:
    """E-10: natural (``{col}_loge``) or base-10 (``{col}_log10``) log; x <= 0 → null."""
    x = F.col(col).cast("double")
    if kind in ("e", "ln", "loge"):
        return df.withColumn(f"{col}_loge", F.when(x > 0, F.ln(x)))
    if kind in ("10", "log10"):
        return df.withColumn(f"{col}_log10", F.when(x > 0, F.log10(x)))
    raise ValueError(f"unknown log kind {kind!r}")


def formula(df: DataFrame, name: str, expression: str) -> DataFrame:
    """E-11: new column from a SQL expression over existing columns."""
    return df.withColumn(name, F.expr(expression))


# The arithmetic operator set offered by the reference.
ARITHMETIC_OPERATORS = ("+", "-", "*", "/", "%", "//")


def arith_expr(left, op: str, right) -> Column:
    """E-12 with Python semantics: ``/`` is true division (x/0 → null),
    ``%`` and ``//`` follow floor rules (sign of the divisor)."""
    lft = _c(left) if isinstance(left, (str, Column)) else F.lit(left)
    rgt = _c(right) if isinstance(right, (str, Column)) else F.lit(right)
    lft, rgt = lft.cast("double"), rgt.cast("double")
    if op == "+":
        return lft + rgt
    if op == "-":
        return lft - rgt
    if op == "*":
        return lft * rgt
    if op == "/":
        return F.try_divide(lft, rgt)
    if op == "//":
        return F.floor(F.try_divide(lft, rgt)).cast("double")
    if op == "%":
        return lft - rgt * F.floor(F.try_divide(lft, rgt))
    raise ValueError(f"unknown operator {op!r}")


def arith(df: DataFrame, name: str, left, op: str, right) -> DataFrame:
    return df.withColumn(name, arith_expr(left, op, right))


# ---- strings (E-15) -------------------------------------------------------

def normalise_name(name: str) -> str:
    """Column-name rule used on save: trim, non-word non-space → '_', lower."""
    import re
    return re.sub(r"[^\w\s]", "_", name.strip()).lower()


def truncate_label(col, keep: int = 8, longer_than: int = 11) -> Column:
    """Long labels cut to ``keep`` characters plus '...' when longer than ``longer_than``."""
    c = _c(col)
    return F.when(F.length(c) > longer_than, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def first_token(col, sep: str = ".") -> Column:
    """Text before the first separator (table name from a file name)."""
    return F.substring_index(_c(col), sep, 1)


def clean_text(col) -> Column:
    return F.lower(F.trim(_c(col)))


# ---- dates (E-16) ---------------------------------------------------------

def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def from_epoch_seconds(col) -> Column:
    """Epoch seconds → wall-clock timestamp (no session time zone involved)."""
    return F.timestamp_add("SECOND", _c(col), _epoch())


def from_epoch_millis(col) -> Column:
    return F.timestamp_add("MILLISECOND", _c(col), _epoch())


def to_local_second(col, hours: float = 5.5) -> Column:
    """Truncate to the second and shift by a fixed offset (IST display rule)."""
    minutes = int(round(hours * 60))
    return F.date_trunc("second", _c(col)) + F.expr(f"INTERVAL {minutes} MINUTES")
