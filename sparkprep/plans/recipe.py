"""Replayable preparation recipes (S-18, S-19).

A recipe is a list of typed steps ``(seq, op, args_json)`` stored as rows of
the ``<base>/_recipes`` Parquet table – never source code.  Replay folds the
steps through a registry of library operators, which only composes a lazy
DataFrame plan; Catalyst optimises the whole recipe as one query.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregate as A
from ..operators import features as E
from ..operators import nulls as N
from ..operators import outliers as OL
from ..operators import relational as R
from ..operators import timeseries as TS
from ..operators import windows as W

RECIPE_SCHEMA = "table string, seq int, op string, args string, modified timestamp_ntz"


def _filter(df, conditions, combine=None):
    return R.filter_conditions(df, {k: tuple(v) for k, v in conditions.items()}, combine)


def _fill(df, plan, order_by=None, partition_by=None):
    steps = [(c, tuple(m) if isinstance(m, list) else m) for c, m in plan]
    return N.fill_plan(df, steps, order_by, partition_by)


REGISTRY = {
    "drop_columns": lambda df, cols: R.drop_columns(df, cols),
    "filter": _filter,
    "group_agg": lambda df, key, spec, order_by=None: A.group_agg(df, key, spec, order_by),
    "group_agg_all": lambda df, key, fn, order_by=None: A.group_agg_all(df, key, fn, order_by),
    "fill": _fill,
    "fill_value": lambda df, value, cols=None: N.fill_value(df, value, cols),
    "dropna": lambda df, cols=None: N.dropna(df, cols),
    "drop_duplicates": lambda df, subset=None: R.drop_duplicates(df, subset),
    "drop_outliers": lambda df, col, method="iqr": OL.drop_outliers(df, col, method),
    "resample_classes": lambda df, col, plan, key, seed=10: OL.resample_classes(
        df, col, {k: tuple(v) for k, v in (plan.items() if isinstance(plan, dict) else plan)}, key, seed),
    "label_encode": lambda df, col: E.label_encode(df, col)[0],
    "ordinal_encode": lambda df, col, classes: E.ordinal_encode(df, col, classes),
    "one_hot": lambda df, col, drop_first=True: E.one_hot(df, col, drop_first),
    "scale": lambda df, kind="standard", cols=None: E.scale(df, kind, cols),
    "trig": lambda df, col, fns: S.trig(df, col, fns),
    "power": lambda df, col, p: S.power(df, col, p),
    "logarithm": lambda df, col, kind="e": S.logarithm(df, col, kind),
    "formula": lambda df, name, expression: S.formula(df, name, expression),
    "arith": lambda df, name, left, op, right: S.arith(df, name, left, op, right),
    "shift": lambda df, col, periods, order_by, partition_by=None: W.shift(df, col, periods, order_by, partition_by),
    "diff": lambda df, col, periods, order_by, partition_by=None: W.diff(df, col, periods, order_by, partition_by),
    "rolling": lambda df, col, window, fn="mean", min_periods=None, center=False, order_by=None,
    partition_by=None: W.rolling(df, col, window, fn, min_periods, center, order_by, partition_by),
    "resample": lambda df, ts, every, unit, fn="mean", cols=None: TS.resample(df, ts, every, unit, fn, cols),
}


def step(op: str, **args) -> dict:
    if op not in REGISTRY:
        raise KeyError(f"unknown recipe operator {op!r}")
    if op == "resample_classes" and isinstance(args.get("plan"), dict):
        # pairs keep the classes' types; JSON would turn object keys into text
        args = args | {"plan": [[k, list(v)] for k, v in args["plan"].items()]}
    return {"op": op, "args": args}


def recipe_replay(df: DataFrame, steps) -> DataFrame:
    """S-19: apply the steps in order (a lazy fold)."""
    out = df
    for s in steps:
        args = s["args"] if isinstance(s["args"], dict) else json.loads(s["args"])
        out = REGISTRY[s["op"]](out, **args)
    return out


def recipes_path(base: str) -> str:
    return f"{base.rstrip('/')}/_recipes"


def recipe_append(spark: SparkSession, base: str, table: str, steps) -> int:
    """S-18: append steps to a table's recipe (sequence continues); returns the
    number of steps now stored.  The append time is the table's modified time."""
    existing = recipe_steps(spark, base, table)
    start = len(existing)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    rows = [(table, start + i, s["op"], json.dumps(s["args"], sort_keys=True)) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "table string, seq int, op string, args string") \
              .withColumn("modified", F.lit(now).cast("timestamp_ntz"))
    df.write.mode("append").parquet(recipes_path(base))
    return start + len(rows)


def recipe_steps(spark: SparkSession, base: str, table: str) -> list[dict]:
    """Stored steps of one table in order (recipe metadata, a handful of rows)."""
    from .._fs import path_exists
    path = recipes_path(base)
    if not path_exists(spark, path):
        return []
    rows = (spark.read.schema(RECIPE_SCHEMA).parquet(path).where(F.col("table") == table)
            .orderBy("seq").collect())
    return [{"op": r["op"], "args": json.loads(r["args"])} for r in rows]


def recipe_info(spark: SparkSession, base: str) -> DataFrame:
    """Per table: number of steps, first and last modification time."""
    return (spark.read.schema(RECIPE_SCHEMA).parquet(recipes_path(base)).groupBy("table")
            .agg(F.count(F.lit(1)).alias("steps"), F.min("modified").alias("created"),
                 F.max("modified").alias("modified")))
