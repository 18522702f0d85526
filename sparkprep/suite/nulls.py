"""Checked queries for null handling (N-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nulls as N
from .base import EVENTS_EDGES, EVENTS_NULLS, events_edges, events_nulls, r4, register

_ORD = "ts, event_id"


@register("n01_fill_zero", f"""
SELECT event_id, ts, user_id, event_type, coalesce(value, 0) AS value, props FROM {EVENTS_NULLS} e""")
def n01_fill_zero(spark, sf):
    return N.fill_value(events_nulls(spark, sf), 0)


@register("n02_ffill", f"""
SELECT event_id, ts, user_id,
  last_value(event_type IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS event_type,
  last_value(value IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM {EVENTS_EDGES} e""")
def n02_ffill(spark, sf):
    return N.ffill(events_edges(spark, sf), ["event_type", "value"], ["ts", "event_id"])


@register("n02_ffill_keyed", f"""
SELECT event_id, ts, user_id, event_type,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_ORD}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM {EVENTS_EDGES} e""")
def n02_ffill_keyed(spark, sf):
    return N.ffill(events_edges(spark, sf), ["value"], ["ts", "event_id"], partition_by="user_id")


@register("n03_bfill", f"""
SELECT event_id, ts, user_id,
  first_value(event_type IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS event_type,
  first_value(value IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM {EVENTS_EDGES} e""")
def n03_bfill(spark, sf):
    return N.bfill(events_edges(spark, sf), ["event_type", "value"], ["ts", "event_id"])


@register("n03_bfill_keyed", f"""
SELECT event_id, ts, user_id, event_type,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_ORD}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM {EVENTS_EDGES} e""")
def n03_bfill_keyed(spark, sf):
    return N.bfill(events_edges(spark, sf), ["value"], ["ts", "event_id"], partition_by="user_id")


def _stat_sql(expr):
    return f"""SELECT event_id, ts, user_id, event_type,
  round(coalesce(value, (SELECT {expr} FROM {EVENTS_NULLS} s)), 4) AS value, props FROM {EVENTS_NULLS} e"""


@register("n04_fill_mean", _stat_sql("avg(value)"))
def n04_fill_mean(spark, sf):
    return r4(N.fill_stat(events_nulls(spark, sf), "value", "mean"))


@register("n05_fill_median", _stat_sql("quantile_cont(value, 0.5)"))
def n05_fill_median(spark, sf):
    return r4(N.fill_stat(events_nulls(spark, sf), "value", "median"))


@register("n06_fill_min", _stat_sql("min(value)"))
def n06_fill_min(spark, sf):
    return r4(N.fill_stat(events_nulls(spark, sf), "value", "min"))


@register("n07_fill_max", _stat_sql("max(value)"))
def n07_fill_max(spark, sf):
    return r4(N.fill_stat(events_nulls(spark, sf), "value", "max"))


def _mode_sql(direction):
    return f"""SELECT event_id, ts, user_id,
  coalesce(event_type, (SELECT event_type FROM {EVENTS_NULLS} m WHERE event_type IS NOT NULL
     GROUP BY event_type ORDER BY count(*) {direction}, event_type LIMIT 1)) AS event_type, value, props
FROM {EVENTS_NULLS} e"""


@register("n08_fill_mode", _mode_sql("DESC"))
def n08_fill_mode(spark, sf):
    return N.fill_stat(events_nulls(spark, sf), "event_type", "mode")


@register("n09_fill_antimode", _mode_sql("ASC"))
def n09_fill_antimode(spark, sf):
    return N.fill_stat(events_nulls(spark, sf), "event_type", "antimode")


@register("n10_fill_custom", f"""
SELECT event_id, ts, user_id, coalesce(event_type, 'unknown') AS event_type, value, props
FROM {EVENTS_NULLS} e""")
def n10_fill_custom(spark, sf):
    return N.fill_value(events_nulls(spark, sf), "unknown")


@register("n11_fill_plan", f"""
WITH f AS (SELECT event_id, ts, user_id,
  last_value(event_type IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS event_type, value FROM {EVENTS_EDGES} e)
SELECT event_id, ts, user_id, event_type,
  round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM f)), 4) AS value FROM f""")
def n11_fill_plan(spark, sf):
    plan = [("event_type", "ffill"), ("value", "median")]
    return r4(N.fill_plan(events_edges(spark, sf), plan, order_by=["ts", "event_id"]))


@register("n12_impute_for_model", f"""
WITH f AS (SELECT event_id, ts, user_id,
  last_value(event_type IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS event_type,
  last_value(value IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM {EVENTS_EDGES} e)
SELECT event_id, ts, user_id,
  first_value(event_type IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS event_type,
  first_value(value IGNORE NULLS) OVER (ORDER BY {_ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM f""")
def n12_impute_for_model(spark, sf):
    return N.impute_for_model(events_edges(spark, sf), ["ts", "event_id"], cols=["event_type", "value"])


@register("n13_dropna", f"SELECT * FROM {EVENTS_NULLS} e WHERE event_type IS NOT NULL AND value IS NOT NULL")
def n13_dropna(spark, sf):
    return N.dropna(events_nulls(spark, sf))
