"""Checked queries for row-ordered windows (E-13, E-14, W-01..W-04, W-08, W-15).

The chunk size is set below the table size so the halo path (rows copied
across chunk edges) is exercised at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .base import EVENTS_NULLS, events_nulls, r4, register, table

CHUNK = 4096
_ORD = "ts, event_id"


def _frame(before, after, keyed=False):
    part = "PARTITION BY user_id " if keyed else ""
    lo = f"{before} PRECEDING" if before > 0 else "CURRENT ROW"
    hi = f"{after} FOLLOWING" if after > 0 else "CURRENT ROW"
    return f"({part}ORDER BY {_ORD} ROWS BETWEEN {lo} AND {hi})"


def _base_cols():
    return "event_id, ts, user_id, event_type, value, props"


@register("w01_rolling_mean", f"""
SELECT {_base_cols()}, round(CASE WHEN count(value) OVER {_frame(4, 0)} >= 3
  THEN avg(value) OVER {_frame(4, 0)} END, 4) AS value_mean_rolling FROM {EVENTS_NULLS} e""")
def w01_rolling_mean(spark, sf):
    return r4(W.rolling(events_nulls(spark, sf), "value", 5, "mean", 3, order_by=["ts", "event_id"],
                        chunk_rows=CHUNK))


@register("w01_rolling_sum_centered_keyed", f"""
SELECT {_base_cols()}, round(CASE WHEN count(value) OVER {_frame(2, 1, True)} >= 1
  THEN coalesce(sum(value) OVER {_frame(2, 1, True)}, 0) END, 4) AS value_sum_rolling FROM {EVENTS_NULLS} e""")
def w01_rolling_sum_centered_keyed(spark, sf):
    return r4(W.rolling(events_nulls(spark, sf), "value", 4, "sum", 1, center=True, order_by=["ts", "event_id"],
                        partition_by="user_id", chunk_rows=CHUNK))


@register("w01_rolling_min_max", f"""
SELECT {_base_cols()},
  CASE WHEN count(value) OVER {_frame(9, 0)} >= 10 THEN min(value) OVER {_frame(9, 0)} END AS value_min_rolling,
  CASE WHEN count(value) OVER {_frame(9, 0)} >= 10 THEN max(value) OVER {_frame(9, 0)} END AS value_max_rolling
FROM {EVENTS_NULLS} e""")
def w01_rolling_min_max(spark, sf):
    return W.rolling(events_nulls(spark, sf), "value", 10, ["min", "max"], order_by=["ts", "event_id"],
                     chunk_rows=CHUNK)


@register("w02_rolling_std_var", f"""
SELECT {_base_cols()},
  round(CASE WHEN count(value) OVER {_frame(6, 0)} >= 2 THEN stddev_samp(value) OVER {_frame(6, 0)} END, 6)
    AS value_std_rolling,
  round(CASE WHEN count(value) OVER {_frame(6, 0)} >= 2 THEN var_samp(value) OVER {_frame(6, 0)} END, 6)
    AS value_var_rolling
FROM {EVENTS_NULLS} e""")
def w02_rolling_std_var(spark, sf):
    # variances of 2-decimal data terminate within 6 decimals or repeat: 6 digits never tie
    return r4(W.rolling(events_nulls(spark, sf), "value", 7, ["std", "var"], 2, order_by=["ts", "event_id"],
                        chunk_rows=CHUNK), 6)


@register("w03_rolling_count", f"""
SELECT {_base_cols()}, CASE WHEN count(*) OVER {_frame(4, 0)} >= 3
  THEN (count(value) OVER {_frame(4, 0)})::DOUBLE END AS value_count_rolling FROM {EVENTS_NULLS} e""")
def w03_rolling_count(spark, sf):
    return W.rolling(events_nulls(spark, sf), "value", 5, "count", 3, order_by=["ts", "event_id"],
                     chunk_rows=CHUNK)


@register("w04_rolling_median", f"""
SELECT {_base_cols()}, round(CASE WHEN count(value) OVER {_frame(2, 2)} >= 1
  THEN quantile_cont(value, 0.5) OVER {_frame(2, 2)} END, 4) AS value_median_rolling FROM {EVENTS_NULLS} e""")
def w04_rolling_median(spark, sf):
    return r4(W.rolling(events_nulls(spark, sf), "value", 5, "median", 1, center=True,
                        order_by=["ts", "event_id"], chunk_rows=CHUNK))


@register("e13_shift", f"""
SELECT {_base_cols()}, lag(value, 3) OVER (PARTITION BY user_id ORDER BY {_ORD}) AS value_shifted_3,
  lead(value, 2) OVER (ORDER BY {_ORD}) AS "value_shifted_-2" FROM {EVENTS_NULLS} e""")
def e13_shift(spark, sf):
    ev = events_nulls(spark, sf)
    a = W.shift(ev, "value", 3, ["ts", "event_id"], "user_id", chunk_rows=CHUNK)
    return W.shift(a, "value", -2, ["ts", "event_id"], chunk_rows=CHUNK)


@register("e14_diff", f"""
SELECT event_id, ts, user_id, value,
  round(value - lag(value, 1) OVER (ORDER BY {_ORD}), 4) + 0.0 AS value_diff FROM events""")
def e14_diff(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return r4(W.diff(ev, "value", 1, ["ts", "event_id"], chunk_rows=CHUNK))


@register("e14_diff_keyed", f"""
SELECT event_id, ts, user_id, value,
  round(value - lag(value, 2) OVER (PARTITION BY user_id ORDER BY {_ORD}), 4) + 0.0 AS value_diff FROM events""")
def e14_diff_keyed(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return r4(W.diff(ev, "value", 2, ["ts", "event_id"], "user_id", chunk_rows=CHUNK))


@register("w15_sequence_windows", f"""
SELECT user_id, ts, event_id, w AS "window", value AS target FROM (
  SELECT user_id, ts, event_id, value,
    list(value) OVER (PARTITION BY user_id ORDER BY {_ORD} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS w
  FROM events) WHERE len(w) = 4""")
def w15_sequence_windows(spark, sf):
    return W.sequence_windows(table(spark, sf, "events"), "value", 4, ["ts", "event_id"], "user_id",
                              chunk_rows=CHUNK)


@register("w08_time_split", f"""
SELECT e.*, CASE WHEN row_number() OVER (ORDER BY {_ORD}) - 1 < floor(count(*) OVER () * 0.8::DOUBLE)
  THEN 'train' ELSE 'test' END AS split FROM events e""")
def w08_time_split(spark, sf):
    return W.time_split(table(spark, sf, "events"), ["ts", "event_id"], 0.2)


@register("w08_time_split_keyed", f"""
SELECT e.*, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY {_ORD}) - 1
  < floor(count(*) OVER (PARTITION BY user_id) * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM events e""")
def w08_time_split_keyed(spark, sf):
    return W.time_split(table(spark, sf, "events"), ["ts", "event_id"], 0.25, partition_by="user_id")
