"""Checked queries for group-by aggregation (A-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import relational as R
from .base import EVENTS_NULLS, events_nulls, r4, register, table


def _flagship(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = R.filter_conditions(li, {"c1": ("l_quantity", ">", 10)})
    out = A.group_agg(kept, "l_returnflag", {
        "l_quantity": ["sum", "mean", "count"],
        "l_extendedprice": ["min", "max", "median", "std"],
        "l_discount": ["var", "nunique", "size"],
    })
    return R.sort_by(r4(out), "l_returnflag")


register("a01_group_agg", """
SELECT l_returnflag,
  round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean,
  count(l_quantity)::BIGINT AS l_quantity_count,
  round(min(l_extendedprice), 4) AS l_extendedprice_min, round(max(l_extendedprice), 4) AS l_extendedprice_max,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice_median,
  round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std,
  round(var_samp(l_discount), 4) AS l_discount_var, count(DISTINCT l_discount)::BIGINT AS l_discount_nunique,
  count(*)::BIGINT AS l_discount_size
FROM lineitem WHERE l_quantity > 10 AND l_returnflag IS NOT NULL
GROUP BY l_returnflag ORDER BY l_returnflag""")(_flagship)


@register("a02_group_agg_all", """
SELECT event_type, round(avg(event_id), 4) AS event_id_mean, round(avg(user_id), 4) AS user_id_mean,
       round(avg(value), 4) AS value_mean
FROM events GROUP BY event_type""")
def a02_group_agg_all(spark, sf):
    return r4(A.group_agg_all(table(spark, sf, "events"), "event_type", "mean"))


# Per-user groups where a fifth of the users have only null values.
_USER_VALUE = "CASE WHEN user_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END"


def _user_values(spark, sf):
    ev = table(spark, sf, "events")
    v = F.when((F.col("user_id") % 5 == 0) | (F.col("event_id") % 7 == 0), F.lit(None)).otherwise(F.col("value"))
    return ev.select("event_id", "ts", "user_id",
                     F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
                     v.alias("value"))


_UV_SQL = f"""(SELECT event_id, ts, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
  {_USER_VALUE} AS value FROM events)"""


@register("a03_mean", f"SELECT user_id, round(avg(value), 4) AS value_mean FROM {_UV_SQL} u GROUP BY user_id")
def a03_mean(spark, sf):
    return r4(A.group_agg(_user_values(spark, sf), "user_id", {"value": ["mean"]}))


@register("a04_median", f"""
SELECT user_id, round(quantile_cont(value, 0.5), 4) AS value_median FROM {_UV_SQL} u GROUP BY user_id""")
def a04_median(spark, sf):
    return r4(A.group_agg(_user_values(spark, sf), "user_id", {"value": ["median"]}))


@register("a05_sum", f"""
SELECT user_id, round(coalesce(sum(value), 0), 4) AS value_sum FROM {_UV_SQL} u GROUP BY user_id""")
def a05_sum(spark, sf):
    return r4(A.group_agg(_user_values(spark, sf), "user_id", {"value": ["sum"]}))


@register("a06_min_max", f"""
SELECT user_id, min(value) AS value_min, max(value) AS value_max,
       min(event_type) AS event_type_min, max(event_type) AS event_type_max
FROM {_UV_SQL} u GROUP BY user_id""")
def a06_min_max(spark, sf):
    return A.group_agg(_user_values(spark, sf), "user_id",
                       {"value": ["min", "max"], "event_type": ["min", "max"]})


@register("a07_count_size", f"""
SELECT user_id, count(value)::BIGINT AS value_count, count(*)::BIGINT AS value_size,
       count(event_type)::BIGINT AS event_type_count
FROM {_UV_SQL} u GROUP BY user_id""")
def a07_count_size(spark, sf):
    return A.group_agg(_user_values(spark, sf), "user_id",
                       {"value": ["count", "size"], "event_type": ["count"]})


@register("a08_std_var", f"""
SELECT user_id, round(stddev_samp(value), 4) AS value_std, round(var_samp(value), 4) AS value_var
FROM {_UV_SQL} u GROUP BY user_id""")
def a08_std_var(spark, sf):
    return r4(A.group_agg(_user_values(spark, sf), "user_id", {"value": ["std", "var"]}))


@register("a09_first_last", f"""
SELECT user_id,
  arg_min(value, ts) FILTER (WHERE value IS NOT NULL) AS value_first,
  arg_max(value, ts) FILTER (WHERE value IS NOT NULL) AS value_last,
  arg_min(event_type, ts) FILTER (WHERE event_type IS NOT NULL) AS event_type_first,
  arg_max(event_type, ts) FILTER (WHERE event_type IS NOT NULL) AS event_type_last
FROM {_UV_SQL} u GROUP BY user_id""")
def a09_first_last(spark, sf):
    return A.group_agg(_user_values(spark, sf), "user_id",
                       {"value": ["first", "last"], "event_type": ["first", "last"]}, order_by=["ts", "event_id"])


@register("a10_nunique", f"""
SELECT event_type, count(DISTINCT user_id)::BIGINT AS user_id_nunique,
       count(DISTINCT value)::BIGINT AS value_nunique
FROM {_UV_SQL} u WHERE event_type IS NOT NULL GROUP BY event_type""")
def a10_nunique(spark, sf):
    return A.group_agg(_user_values(spark, sf), "event_type", {"user_id": ["nunique"], "value": ["nunique"]})


@register("a11_quantile", """
SELECT round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem""")
def a11_quantile(spark, sf):
    return r4(A.quantile(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("a01_group_agg_multi_key", f"""
SELECT event_type, user_id % 3 AS ubin, round(avg(value), 4) AS value_mean, count(*)::BIGINT AS value_size
FROM {EVENTS_NULLS} e WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def a01_group_agg_multi_key(spark, sf):
    ev = events_nulls(spark, sf).withColumn("ubin", F.col("user_id") % 3)
    return r4(A.group_agg(ev, ["event_type", "ubin"], {"value": ["mean", "size"]}))
