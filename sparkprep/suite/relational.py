"""Checked queries for sources (read), projection, filter, joins, unions, sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import relational as R
from .base import (CUSTOMER_NULL_KEYS, EVENTS_NULLS, customer_null_keys, events_nulls, r4,
                   register, table)


@register("s02_read_table", "SELECT * FROM lineitem")
def s02_read_table(spark, sf):
    from ..sources.tables import read_table
    return read_table(spark, sf, "lineitem")


@register("p01_drop_columns", "SELECT event_id, ts, user_id, event_type FROM events")
def p01_drop_columns(spark, sf):
    return R.drop_columns(table(spark, sf, "events"), ["value", "props"])


@register("p02_columns_of_kind", "SELECT event_id, user_id, value FROM events")
def p02_columns_of_kind(spark, sf):
    return R.select_kind(table(spark, sf, "events"), include=("numeric",))


@register("p03_filter_conditions", """
SELECT * FROM lineitem
WHERE coalesce(l_quantity > 10, false)
  AND (coalesce(l_returnflag = 'R', false) OR NOT (l_discount IS NOT DISTINCT FROM 0.05))""")
def p03_filter_conditions(spark, sf):
    conds = {"c1": ("l_quantity", ">", 10), "c2": ("l_returnflag", "==", "R"),
             "c3": ("l_discount", "!=", 0.05)}
    return R.filter_conditions(table(spark, sf, "lineitem"), conds, "c1 & (c2 | c3)")


@register("p03_filter_conditions_nulls", f"""
SELECT * FROM {EVENTS_NULLS} e
WHERE (coalesce(value > 100, false) OR NOT (event_type IS NOT DISTINCT FROM 'click'))
  AND NOT coalesce(value <= 2, false)""")
def p03_filter_conditions_nulls(spark, sf):
    conds = {"c1": ("value", ">", 100), "C2": ("event_type", "!=", "click"), "c3": ("value", "<=", 2)}
    return R.filter_conditions(events_nulls(spark, sf), conds, "(c1 | C2) & ~c3")


_OPS = ("==", "!=", ">", "<", ">=", "<=")
_OPS_SQL = {"==": "coalesce(value = 50.0, false)", "!=": "NOT (value IS NOT DISTINCT FROM 50.0)",
            ">": "coalesce(value > 50.0, false)", "<": "coalesce(value < 50.0, false)",
            ">=": "coalesce(value >= 50.0, false)", "<=": "coalesce(value <= 50.0, false)"}


@register("p04_comparisons", " UNION ALL ".join(
    f"SELECT '{op}' AS op, count(*)::BIGINT AS n FROM {EVENTS_NULLS} e WHERE {_OPS_SQL[op]}" for op in _OPS))
def p04_comparisons(spark, sf):
    ev = events_nulls(spark, sf)
    parts = [R.filter_conditions(ev, {"c1": ("value", op, 50.0)}).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(op).alias("op"), "n") for op in _OPS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("p05_distinct_values", f"SELECT DISTINCT event_type FROM {EVENTS_NULLS} e WHERE event_type IS NOT NULL")
def p05_distinct_values(spark, sf):
    return R.distinct_values(events_nulls(spark, sf), "event_type")


_LI_ORDER = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
             "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


@register("p06_preview", f"SELECT * FROM lineitem ORDER BY {_LI_ORDER} LIMIT 100")
def p06_preview(spark, sf):
    return R.preview(table(spark, sf, "lineitem"), 100, [c.strip() for c in _LI_ORDER.split(",")])


@register("p07_tail", "SELECT * FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 50) ORDER BY ts")
def p07_tail(spark, sf):
    return R.tail(table(spark, sf, "events"), 50, "ts")


@register("p08_round_numeric",
          "SELECT event_id, user_id, round(value / 7, 3) AS v7, round(value * 1.0 / 3, 3) AS v3 FROM events")
def p08_round_numeric(spark, sf):
    ev = table(spark, sf, "events")
    df = ev.select("event_id", "user_id", (F.col("value") / 7).alias("v7"), (F.col("value") / 3).alias("v3"))
    return R.round_numeric(df, 3)


@register("p09_drop_datetime",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def p09_drop_datetime(spark, sf):
    return R.drop_datetime(table(spark, sf, "orders"))


# ---- joins -------------------------------------------------------------------

@register("j01_merge_inner", """
SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def j01_merge_inner(spark, sf):
    return R.merge(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "inner")


@register("j02_merge_outer", f"""
SELECT c.*, n.* FROM {CUSTOMER_NULL_KEYS} c FULL OUTER JOIN nation n
  ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey""")
def j02_merge_outer(spark, sf):
    return R.merge(customer_null_keys(spark, sf), table(spark, sf, "nation"), "c_nationkey", "n_nationkey", "outer")


@register("j03_merge_left", f"""
SELECT c.*, n.* FROM {CUSTOMER_NULL_KEYS} c LEFT JOIN nation n
  ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey""")
def j03_merge_left(spark, sf):
    return R.merge(customer_null_keys(spark, sf), table(spark, sf, "nation"), "c_nationkey", "n_nationkey", "left")


_URGENT_KEY = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END"


@register("j04_merge_right", f"""
SELECT o.*, c.* FROM (SELECT * REPLACE ({_URGENT_KEY} AS o_custkey) FROM orders) o
RIGHT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def j04_merge_right(spark, sf):
    """Orders that are not urgent have no key: they drop out, and customers without a partner stay."""
    o = table(spark, sf, "orders").withColumn("o_custkey", F.expr(_URGENT_KEY))
    return R.merge(o, table(spark, sf, "customer"), "o_custkey", "c_custkey", "right")


_USER_NULL = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END"


@register("j05_merge_same_name", f"""
WITH l AS (SELECT {_USER_NULL} AS user_id, event_type, value FROM events),
     r AS (SELECT user_id, max(value) AS value, count(*)::BIGINT AS n FROM l GROUP BY user_id)
SELECT coalesce(l.user_id, r.user_id) AS user_id, l.event_type, l.value AS value_x,
       r.value AS value_y, r.n
FROM l FULL OUTER JOIN r ON l.user_id IS NOT DISTINCT FROM r.user_id""")
def j05_merge_same_name(spark, sf):
    ev = table(spark, sf, "events")
    left = ev.select(F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
                     "event_type", "value")
    right = left.groupBy("user_id").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return R.merge(left, right, "user_id", how="outer")


@register("j06_drop_rows", """
SELECT * FROM customer WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def j06_drop_rows(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"))
    return R.drop_rows(table(spark, sf, "customer"), urgent, "c_custkey")


# ---- unions, duplicates, order ----------------------------------------------------

@register("u01_concat", """
SELECT event_id, ts, user_id, event_type, value, NULL::VARCHAR AS props, NULL::BOOLEAN AS flag
FROM events WHERE event_type = 'click'
UNION ALL
SELECT event_id, ts, user_id, event_type, value, props, value > 100 AS flag
FROM events WHERE event_type <> 'click'""")
def u01_concat(spark, sf):
    ev = table(spark, sf, "events")
    a = ev.where("event_type = 'click'").drop("props")
    b = ev.where("event_type <> 'click'").withColumn("flag", F.col("value") > 100)
    return R.concat([a, b])


_DUP_SRC_SQL = f"(SELECT user_id, event_type, floor(value / 50)::BIGINT AS vbin FROM {EVENTS_NULLS} e)"


def _dup_src(spark, sf):
    return events_nulls(spark, sf).select("user_id", "event_type",
                                          F.floor(F.col("value") / 50).cast("long").alias("vbin"))


@register("u02_duplicate_count", f"""
SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DUP_SRC_SQL} d)))::BIGINT AS duplicates
FROM {_DUP_SRC_SQL} d2""")
def u02_duplicate_count(spark, sf):
    return R.duplicate_count(_dup_src(spark, sf))


@register("u03_duplicate_rows", f"""
SELECT user_id, event_type, vbin FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, event_type, vbin) AS c FROM {_DUP_SRC_SQL} d) WHERE c > 1""")
def u03_duplicate_rows(spark, sf):
    return R.duplicate_rows(_dup_src(spark, sf))


@register("u04_drop_duplicates", f"SELECT DISTINCT * FROM {_DUP_SRC_SQL} d")
def u04_drop_duplicates(spark, sf):
    return R.drop_duplicates(_dup_src(spark, sf))


@register("u05_sort_by", "SELECT * FROM events ORDER BY ts")
def u05_sort_by(spark, sf):
    return R.sort_by(table(spark, sf, "events"), "ts")


@register("u06_value_counts", f"""
SELECT event_type, count(*)::BIGINT AS count FROM {EVENTS_NULLS} e
WHERE event_type IS NOT NULL GROUP BY event_type""")
def u06_value_counts(spark, sf):
    return R.value_counts(events_nulls(spark, sf), "event_type")


@register("u07_mode_value", """
(SELECT 'most' AS which, value, count FROM (SELECT o_orderpriority AS value, count(*)::BIGINT AS count
   FROM orders GROUP BY 1) ORDER BY count DESC, value LIMIT 1)
UNION ALL
(SELECT 'least' AS which, value, count FROM (SELECT o_orderpriority AS value, count(*)::BIGINT AS count
   FROM orders GROUP BY 1) ORDER BY count ASC, value LIMIT 1)""")
def u07_mode_value(spark, sf):
    o = table(spark, sf, "orders")
    most = R.mode_value(o, "o_orderpriority").select(F.lit("most").alias("which"), "value", "count")
    least = R.mode_value(o, "o_orderpriority", least=True).select(F.lit("least").alias("which"), "value", "count")
    return most.unionByName(least)
