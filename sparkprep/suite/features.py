"""Checked queries for encoders, scalers and scalar functions (E-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import features as E
from .base import r4, register, table


@register("e01_label_encode", """
SELECT *, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS p_brand_encoded FROM part""")
def e01_label_encode(spark, sf):
    out, _ = E.label_encode(table(spark, sf, "part"), "p_brand")
    return out


@register("e02_ordinal_encode", """
SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1
          END::BIGINT AS o_orderpriority_encoded FROM orders""")
def e02_ordinal_encode(spark, sf):
    return E.ordinal_encode(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("e03_one_hot_drop_first", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, " + ", ".join(
    f"(p_type = '{t}')::BIGINT AS \"p_type_{t}\"" for t in _TYPES[1:]) + " FROM part")
def e03_one_hot_drop_first(spark, sf):
    return E.one_hot(table(spark, sf, "part"), "p_type", drop_first=True)


@register("e04_one_hot", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
  (o_orderstatus = 'F')::BIGINT AS o_orderstatus_F, (o_orderstatus = 'O')::BIGINT AS o_orderstatus_O,
  (o_orderstatus = 'P')::BIGINT AS o_orderstatus_P FROM orders""")
def e04_one_hot(spark, sf):
    return E.one_hot(table(spark, sf, "orders"), "o_orderstatus", drop_first=False)


@register("e05_scale_standard", """
SELECT *, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 4)
  AS value_scaled FROM events""")
def e05_scale_standard(spark, sf):
    return r4(E.scale(table(spark, sf, "events"), "standard", "value"))


@register("e05_scale_standard_table", """
WITH s AS (SELECT avg(o_orderkey) AS a1, stddev_pop(o_orderkey) AS s1, avg(o_custkey) AS a2,
  stddev_pop(o_custkey) AS s2, avg(o_totalprice) AS a3, stddev_pop(o_totalprice) AS s3 FROM orders)
SELECT round((o_orderkey - a1) / s1, 4) AS o_orderkey, round((o_custkey - a2) / s2, 4) AS o_custkey,
  o_orderstatus, round((o_totalprice - a3) / s3, 4) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders, s""")
def e05_scale_standard_table(spark, sf):
    return r4(E.scale(table(spark, sf, "orders"), "standard"))


@register("e06_scale_minmax", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l.*, round((l_extendedprice - lo) / (hi - lo), 4) AS l_extendedprice_scaled FROM lineitem l, s""")
def e06_scale_minmax(spark, sf):
    return r4(E.scale(table(spark, sf, "lineitem"), "minmax", "l_extendedprice"))


@register("e07_scale_robust", """
WITH s AS (SELECT quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
           FROM events)
SELECT e.*, round((value - med) / iqr, 4) AS value_scaled FROM events e, s""")
def e07_scale_robust(spark, sf):
    return r4(E.scale(table(spark, sf, "events"), "robust", "value"))


_TRIG_SQL = {"sin": "sin", "cos": "cos", "tan": "tan", "arcsin": "asin", "arccos": "acos", "arctan": "atan",
             "sinh": "sinh", "cosh": "cosh", "tanh": "tanh"}


@register("e08_trig", "SELECT event_id, x, " + ", ".join(
    f"round({fn}(x), 4) AS x_{name}" for name, fn in _TRIG_SQL.items()) +
    " FROM (SELECT event_id, value / 100 AS x FROM events)")
def e08_trig(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("x"))
    return r4(S.trig(df, "x"))


@register("e09_power", """
SELECT event_id, value, round(pow(value, 0.5), 4) AS "value^0.5", round(pow(value, 3), 4) AS "value^3.0"
FROM events""")
def e09_power(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return r4(S.power(S.power(df, "value", 0.5), "value", 3))


@register("e10_logarithm", """
SELECT event_id, x, round(CASE WHEN x > 0 THEN ln(x) END, 4) AS x_loge,
       round(CASE WHEN x > 0 THEN log10(x) END, 4) AS x_log10
FROM (SELECT event_id, value - 5 AS x FROM events)""")
def e10_logarithm(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") - 5).alias("x"))
    return r4(S.logarithm(S.logarithm(df, "x", "e"), "x", "10"))


@register("e11_formula", """
SELECT l.*, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem l""")
def e11_formula(spark, sf):
    out = S.formula(table(spark, sf, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return r4(out)


@register("e12_arith", """
SELECT event_id, l, d, round(l + d, 4) + 0.0 AS "sum", round(l - d, 4) + 0.0 AS diff,
  round(l * d, 4) + 0.0 AS prod, round(CASE WHEN d = 0 THEN NULL ELSE l / d END, 4) + 0.0 AS quot,
  round(CASE WHEN d = 0 THEN NULL ELSE l - d * floor(l / d) END, 4) + 0.0 AS "mod",
  CASE WHEN d = 0 THEN NULL ELSE floor(l / d) END + 0.0 AS floordiv
FROM (SELECT event_id, value - 100 AS l, ((user_id % 7) - 3)::DOUBLE AS d FROM events)""")
def e12_arith(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") - 100).alias("l"),
                                           ((F.col("user_id") % 7) - 3).cast("double").alias("d"))
    for name, op in (("sum", "+"), ("diff", "-"), ("prod", "*"), ("quot", "/"), ("mod", "%"), ("floordiv", "//")):
        df = S.arith(df, name, "l", op, "d")
    return r4(df)


@register("e15_string_helpers", """
SELECT p_partkey, lower(trim(p_name)) AS clean, regexp_replace(p_name, '[^\\w\\s]', '_', 'g') AS word_safe,
  split_part(p_brand, '#', 1) AS brand_head,
  CASE WHEN length(p_name) > 11 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS label FROM part""")
def e15_string_helpers(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.clean_text("p_name").alias("clean"),
                    F.regexp_replace("p_name", r"[^\w\s]", "_").alias("word_safe"),
                    S.first_token("p_brand", "#").alias("brand_head"),
                    S.truncate_label("p_name").alias("label"))


@register("e16_date_helpers", """
SELECT event_id, make_timestamp((1704067200 + event_id * 60) * 1000000) AS from_seconds,
  make_timestamp((1704067200000 + event_id * 1500) * 1000) AS from_millis,
  date_trunc('second', ts) + INTERVAL 330 MINUTE AS local_second FROM events""")
def e16_date_helpers(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", S.from_epoch_seconds(F.lit(1704067200) + F.col("event_id") * 60).alias("from_seconds"),
                     S.from_epoch_millis(F.lit(1704067200000) + F.col("event_id") * 1500).alias("from_millis"),
                     S.to_local_second("ts").alias("local_second"))
