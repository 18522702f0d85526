"""Whole-table cleaning and content-based type inference (S-08, S-09).

Inference is one aggregate pass: for every string column and every candidate
type it counts the non-null values and the values that convert.  A type wins
only if every non-null value converts (priority numeric → datetime →
boolean); the winning conversions are then applied in one ``select``.  The
driver only sees a single row of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P
from ..functions.scalar import normalise_name
from .relational import q


PROBE_ROWS = 20000


def _candidate_exprs(cols, formats):
    """Per column: (name, condition) pairs counted by the inference pass."""
    out = {}
    for i, c in enumerate(cols):
        s, num_txt = F.col(f"__t{i}"), F.col(f"__n{i}")
        present = s.isNotNull() & (s != "")
        # a cheap gate in front of the format tests
        looks_date = s.rlike(r"(?i)^(\d{1,4}[-/. ]\w|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d)")
        # every text of the number shape converts to double, so the shape alone decides
        out[c] = [(f"num{i}", present & num_txt.rlike(P.NUMBER_SHAPE)),
                  # whole numbers beyond bigint stay with the double branch
                  (f"int{i}", present & num_txt.rlike(r"^[+-]?\d+$") & num_txt.try_cast("bigint").isNotNull()),
                  (f"bool{i}", s.isNotNull() & P.is_boolean_text(s))]
        out[c] += [(f"dt{i}_{j}", present & looks_date & P.parse_datetime(s, fmt).isNotNull())
                   for j, fmt in enumerate(formats)]
    return out


def _base_counts(cols):
    aggs = []
    for i, c in enumerate(cols):
        s = F.col(f"__t{i}")
        aggs += [F.count_if(s.isNotNull()).alias(f"nn{i}"), F.count_if(s.isNotNull() & (s != "")).alias(f"pr{i}")]
    return aggs + [F.count(F.lit(1)).alias("__rows")]


def _candidate_counts(df: DataFrame, cols, formats):
    """Counts of converting values per candidate type.

    A type is kept only if *every* value converts, so a failure on any row is
    final: candidates are first tested on a bounded prefix of rows, and the
    full scan only counts the survivors (usually one per column)."""
    cand = _candidate_exprs(cols, formats)
    # trimmed text and numeric text are projected once per row, not per test
    trimmed = df.select(*[F.trim(F.col(q(c))).alias(f"__t{i}") for i, c in enumerate(cols)])
    df = trimmed.select("*", *[P.numeric_text(F.col(f"__t{i}")).alias(f"__n{i}") for i in range(len(cols))])
    probe = df.limit(PROBE_ROWS).agg(*_base_counts(cols), *[e.alias(n) for c in cols for n, e in
                                                           [(n, F.count_if(x)) for n, x in cand[c]]]).first()
    alive = []
    for i, c in enumerate(cols):
        for n, x in cand[c]:
            need = probe[f"nn{i}"] if n.startswith("bool") else probe[f"pr{i}"]
            if probe[n] == need:
                alive.append((n, x))
    row = df.agg(*_base_counts(cols), *[F.count_if(x).alias(n) for n, x in alive]).first().asDict()
    for c in cols:
        for n, _ in cand[c]:
            row.setdefault(n, -1)  # eliminated on the probe rows
    return row


def infer_types(df: DataFrame, formats=P.DEFAULT_DATETIME_FORMATS):
    """S-09: returns ``(typed_df, decisions)`` where decisions maps column → type."""
    str_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    decisions = {}
    if not str_cols:
        return df, decisions
    row = _candidate_counts(df, str_cols, formats)
    exprs = []
    for f in df.schema.fields:
        c = f.name
        if c not in str_cols:
            exprs.append(F.col(q(c)))
            continue
        i = str_cols.index(c)
        s = F.trim(F.col(q(c)))
        nn, pr = row[f"nn{i}"], row[f"pr{i}"]
        if pr > 0 and row[f"num{i}"] == pr:
            if row[f"int{i}"] == pr:
                decisions[c] = "bigint"
                exprs.append(P.numeric_text(s).try_cast("bigint").alias(c))
            else:
                decisions[c] = "double"
                exprs.append(P.parse_numeric(s).alias(c))
            continue
        fmt = next((fmt for j, fmt in enumerate(formats) if pr > 0 and row[f"dt{i}_{j}"] == pr), None)
        if fmt is not None:
            decisions[c] = f"timestamp:{fmt}"
            exprs.append(F.when(s != "", P.parse_datetime(s, fmt)).alias(c))
            continue
        if nn > 0 and nn == row["__rows"] and row[f"bool{i}"] == nn:
            decisions[c] = "boolean"
            exprs.append(P.parse_boolean(s).alias(c))
            continue
        decisions[c] = "string"
        exprs.append(s.alias(c))
    return df.select(*exprs), decisions


def drop_empty(df: DataFrame):
    """Drop all-null rows and all-null columns (one count pass for the columns)."""
    rows_kept = df.na.drop(how="all")
    counts = rows_kept.agg(*[F.count(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    empty_cols = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] == 0]
    return rows_kept.drop(*empty_cols), empty_cols


def clean_table(df: DataFrame, formats=P.DEFAULT_DATETIME_FORMATS):
    """S-08: drop empty rows/columns, normalise names, infer each column's type.

    Returns ``(df, log)``; ``log`` lists the steps taken.
    """
    log = []
    names = [normalise_name(c) for c in df.columns]
    df = df.toDF(*names)
    df, empty_cols = drop_empty(df)
    log.append("Removed empty rows and columns" + (f": {', '.join(empty_cols)}" if empty_cols else ""))
    log.append("Standardized column names")
    df, decisions = infer_types(df, formats)
    for c, t in decisions.items():
        log.append(f"Cleaned column: {c} -> {t}")
    return df, log
