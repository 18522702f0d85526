"""Checked queries for profiling and statistics (D-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as D
from .base import EVENTS_NULLS, events_nulls, r4, register, table

_EV_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
            ("event_type", "string"), ("value", "double"), ("props", "string")]


def _profile_sql():
    parts = []
    for c, t in _EV_COLS:
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c})::BIGINT AS non_null,
  round(round(1 - count({c}) / count(*), 1) * 100, 1) AS null_pct,
  CASE WHEN count(DISTINCT {c}) / count(*) < 0.03 AND count(DISTINCT {c}) > 1
            AND count(DISTINCT {c}) <= 30 THEN 'Yes' ELSE 'No' END AS categorical
FROM {EVENTS_NULLS} e""")
    return "\nUNION ALL\n".join(parts)


@register("d01_profile", _profile_sql())
def d01_profile(spark, sf):
    return D.profile(events_nulls(spark, sf))


def _categorical_sql():
    parts = [f"""SELECT '{c}' AS "column", count(DISTINCT {c})::BIGINT AS levels, count(*) AS n
FROM orders""" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                          "o_orderpriority")]
    return ("SELECT \"column\", levels FROM (" + " UNION ALL ".join(parts) +
            ") WHERE levels / n < 0.03 AND levels > 1 AND levels <= 30")


@register("d02_categorical_columns", _categorical_sql())
def d02_categorical_columns(spark, sf):
    return D.categorical_table(table(spark, sf, "orders"))


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


def _describe_sql():
    stats = [("count", "count({c})::DOUBLE"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
             ("min", "min({c})::DOUBLE"), ("25%", "quantile_cont({c}::DOUBLE, 0.25)"),
             ("50%", "quantile_cont({c}::DOUBLE, 0.5)"), ("75%", "quantile_cont({c}::DOUBLE, 0.75)"),
             ("max", "max({c})::DOUBLE")]
    parts = []
    for name, tmpl in stats:
        cols = ", ".join(f"round({tmpl.format(c=c)}, 4) + 0.0 AS {c}" for c in _LI_NUM)
        parts.append(f"SELECT '{name}' AS statistic, {cols} FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("d03_describe", _describe_sql())
def d03_describe(spark, sf):
    return r4(D.describe(table(spark, sf, "lineitem")))


@register("d03_describe_datetimes", """
WITH o AS (SELECT epoch(o_orderdate) AS s FROM orders),
e AS (SELECT epoch(ts) AS s FROM events),
r AS (SELECT 'o_orderdate' AS "column", count(s)::BIGINT AS count, avg(s) AS mean, min(s) AS min, quantile_cont(s, 0.25) AS p25,
             quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.75) AS p75, max(s) AS max FROM o
      UNION ALL SELECT 'ts', count(s)::BIGINT, avg(s), min(s), quantile_cont(s, 0.25), quantile_cont(s, 0.5), quantile_cont(s, 0.75), max(s) FROM e)
SELECT "column", count, make_timestamp((round(mean) * 1000000)::BIGINT) AS mean, make_timestamp((round(min) * 1000000)::BIGINT) AS min,
       make_timestamp((round(p25) * 1000000)::BIGINT) AS p25, make_timestamp((round(p50) * 1000000)::BIGINT) AS p50,
       make_timestamp((round(p75) * 1000000)::BIGINT) AS p75, make_timestamp((round(max) * 1000000)::BIGINT) AS max FROM r""")
def d03_describe_datetimes(spark, sf):
    return D.describe_datetimes(table(spark, sf, "orders")).unionByName(D.describe_datetimes(table(spark, sf, "events")))


@register("d04_null_columns", f"""
SELECT * FROM (
  SELECT 'event_type' AS "column", count_if(event_type IS NULL)::BIGINT AS null_count FROM {EVENTS_NULLS} e
  UNION ALL SELECT 'value', count_if(value IS NULL)::BIGINT FROM {EVENTS_NULLS} e
  UNION ALL SELECT 'event_id', count_if(event_id IS NULL)::BIGINT FROM {EVENTS_NULLS} e
) WHERE null_count > 0""")
def d04_null_columns(spark, sf):
    return D.null_columns(events_nulls(spark, sf))


@register("d05_imbalance_columns", f"""
SELECT * FROM (
  SELECT 'event_type' AS "column",
         (count(DISTINCT event_type) + max(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END))::BIGINT AS levels
  FROM {EVENTS_NULLS} e
  UNION ALL
  SELECT 'props', (count(DISTINCT props) + max(CASE WHEN props IS NULL THEN 1 ELSE 0 END))::BIGINT
  FROM {EVENTS_NULLS} e
) WHERE levels <= 10""")
def d05_imbalance_columns(spark, sf):
    return D.imbalance_table(events_nulls(spark, sf))


@register("d07_is_multiclass", """
SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus)::BIGINT AS n_classes,
       count(DISTINCT o_orderstatus) <> 2 AS multiclass FROM orders
UNION ALL
SELECT 'toxic', count(DISTINCT toxic)::BIGINT, count(DISTINCT toxic) <> 2 FROM labels""")
def d07_is_multiclass(spark, sf):
    a = D.is_multiclass(table(spark, sf, "orders"), "o_orderstatus").select(F.lit("o_orderstatus").alias("target"), "*")
    b = D.is_multiclass(table(spark, sf, "labels"), "toxic").select(F.lit("toxic").alias("target"), "*")
    return a.unionByName(b)


@register("d08_feature_profile", """
SELECT 'o_orderstatus' AS feature, 'categorical' AS kind, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value,
       count(DISTINCT o_orderstatus)::BIGINT AS n_distinct FROM orders
UNION ALL SELECT 'o_totalprice', 'numeric', min(o_totalprice), max(o_totalprice),
       count(DISTINCT o_totalprice)::BIGINT FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', NULL, NULL, count(DISTINCT o_orderpriority)::BIGINT FROM orders""")
def d08_feature_profile(spark, sf):
    return D.feature_profile(table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@register("d08_feature_values", """
SELECT DISTINCT 'o_orderstatus' AS feature, o_orderstatus AS value FROM orders
UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders""")
def d08_feature_values(spark, sf):
    return D.feature_values(table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@register("d08_feature_profile_numeric", """
SELECT 'l_quantity' AS feature, 'numeric' AS kind, min(l_quantity)::DOUBLE AS min_value, max(l_quantity)::DOUBLE AS max_value,
       count(DISTINCT l_quantity)::BIGINT AS n_distinct, 0::BIGINT AS listed FROM lineitem
UNION ALL SELECT 'l_tax', 'numeric', min(l_tax)::DOUBLE, max(l_tax)::DOUBLE, count(DISTINCT l_tax)::BIGINT, 0::BIGINT FROM lineitem""")
def d08_feature_profile_numeric(spark, sf):
    """Features without any categorical one: the profile stands, and no value is listed."""
    li, cols = table(spark, sf, "lineitem"), ["l_quantity", "l_tax"]
    listed = D.feature_values(li, cols).groupBy("feature").agg(F.count("*").alias("listed"))
    return D.feature_profile(li, cols).join(listed, "feature", "left").withColumn("listed", F.coalesce("listed", F.lit(0)).cast("long"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for a in _CORR:
        for b in _CORR:
            v = "1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 4)"
            src = "" if a == b else " FROM lineitem"
            parts.append(f"SELECT '{a}' AS \"column\", '{b}' AS other, {v} AS corr{src}")
    return "\nUNION ALL\n".join(parts)


@register("d09_correlation", _corr_sql())
def d09_correlation(spark, sf):
    return r4(D.correlation(table(spark, sf, "lineitem"), _CORR))


def _dummy_corr_sql():
    cols = {"o_totalprice": "o_totalprice", **{f"o_orderstatus_{k}": f"(o_orderstatus = '{k}')::INT" for k in "FOP"}}
    parts = [f"""SELECT '{a}' AS "column", '{b}' AS other, {"1.0::DOUBLE" if a == b else f"round(corr({x}, {y}), 4)"} AS corr FROM orders{" LIMIT 1" if a == b else ""}"""
             for a, x in cols.items() for b, y in cols.items()]
    return " UNION ALL ".join(f"({p})" for p in parts)


@register("d09_correlation_dummies", _dummy_corr_sql())
def d09_correlation_dummies(spark, sf):
    return r4(D.correlation(table(spark, sf, "orders"), ["o_totalprice"], dummies=["o_orderstatus"]))


@register("d10_class_share", """
WITH c AS (SELECT role AS class, count(*)::BIGINT AS count FROM conversations GROUP BY role)
SELECT class, CASE WHEN length(class) > 11 THEN substr(class, 1, 8) || '...' ELSE class END AS label,
       count, round(count * 100.0 / (SELECT sum(count) FROM c), 2) AS percent FROM c""")
def d10_class_share(spark, sf):
    return D.class_share(table(spark, sf, "conversations"), "role")


@register("d11_class_table", f"""
SELECT event_type AS class, count(*)::BIGINT AS count,
       round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1) AS null_pct
FROM {EVENTS_NULLS} e WHERE event_type IS NOT NULL GROUP BY event_type""")
def d11_class_table(spark, sf):
    return D.class_table(events_nulls(spark, sf), "event_type")
