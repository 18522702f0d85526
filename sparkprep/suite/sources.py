"""Checked queries for sources, sinks, table catalog and recipes (S-*).

Queries that exercise a writer land their files in a fresh folder under the
session's shared checkpoint directory and read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .._fs import scratch_dir
from ..operators import maintenance as MT
from ..operators.profile import attach_scalars
from ..plans import recipe as RC
from ..sources import files as SF
from ..sources import tables as ST
from .base import EVENTS_NULLS, events_nulls, r4, register, table
from .cleaning import _TYPED_SQL, _dirty_lineitem


@register("s01_read_csv", _TYPED_SQL.replace("SELECT l_orderkey, l_linenumber,",
                                             "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,"))
def s01_read_csv(spark, sf):
    path = scratch_dir(spark, "csv")
    _dirty_lineitem(spark, sf).write.option("header", True).csv(path)
    df, _ = SF.read_csv(spark, path)
    return r4(df)


@register("s03_read_json", """
SELECT event_id, value, json_extract(props, '$.k')::BIGINT AS props_k, user_id AS meta_user_id,
       event_type AS meta_type FROM events""")
def s03_read_json(spark, sf):
    path = scratch_dir(spark, "json")
    ev = table(spark, sf, "events")
    payload = ev.select("event_id", "value", F.from_json("props", "k long").alias("props"),
                        F.struct(F.col("user_id").alias("user_id"), F.col("event_type").alias("type")).alias("meta"))
    payload.write.json(path)
    return SF.read_json_records(spark, path)


@register("s07_read_devices", """
SELECT user_id AS device_id, ts, value FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def s07_read_devices(spark, sf):
    path = scratch_dir(spark, "devices")
    ev = table(spark, sf, "events").select(F.col("user_id").alias("device_id"), "ts", "value")
    SF.write_devices(ev, path)
    return SF.read_devices(spark, path, sensors=["value"], start="2024-01-05 00:00:00", end="2024-01-20 12:00:00")


@register("s13_create_table", "SELECT * FROM orders")
def s13_create_table(spark, sf):
    base = scratch_dir(spark, "tables")
    ST.create_table(table(spark, sf, "orders"), base, "orders.csv")
    return ST.read_table(spark, base, "orders")


@register("s14_update_table", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def s14_update_table(spark, sf):
    base = scratch_dir(spark, "tables")
    ST.create_table(table(spark, sf, "orders"), base, "orders")
    current = ST.read_table(spark, base, "orders")
    ST.update_table(current.where("o_orderstatus = 'F'"), base, "orders")
    return ST.read_table(spark, base, "orders")


@register("s15_export_csv", "SELECT * FROM orders")
def s15_export_csv(spark, sf):
    path = scratch_dir(spark, "export")
    ST.export_csv(table(spark, sf, "orders"), path)
    df, _ = SF.read_csv(spark, path)
    return df


@register("s16_table_catalog")
def s16_table_catalog(spark, sf):
    base = scratch_dir(spark, "tables")
    ST.create_table(table(spark, sf, "orders"), base, "orders")
    ST.create_table(table(spark, sf, "customer"), base, "customer")
    return ST.table_catalog(spark, base)


_RECIPE = [
    RC.step("fill", plan=[["value", "median"]]),
    RC.step("filter", conditions={"c1": ["value", ">", 10], "c2": ["event_type", "!=", "click"]}, combine="c1 & c2"),
    RC.step("group_agg", key="event_type", spec={"value": ["mean", "count"], "user_id": ["nunique"]}),
]


def _replay_sql(src, more=""):
    return f"""
WITH f AS (SELECT event_id, user_id, event_type,
             coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {src} m)) AS value
           FROM {src} e),
k AS (SELECT * FROM f WHERE coalesce(value > 10, false) AND NOT (event_type IS NOT DISTINCT FROM 'click'))
SELECT event_type, round(avg(value), 4) AS value_mean, count(value)::BIGINT AS value_count,
       count(DISTINCT user_id)::BIGINT AS user_id_nunique{more}
FROM k WHERE event_type IS NOT NULL GROUP BY event_type"""


@register("s18_recipe_log", _replay_sql("events", ", 3::BIGINT AS steps"))
def s18_recipe_log(spark, sf):
    """A recipe logged in two appends and replayed on ``events``, with the number of logged steps."""
    base = scratch_dir(spark, "recipes")
    RC.recipe_append(spark, base, "events", _RECIPE[:1])
    RC.recipe_append(spark, base, "events", _RECIPE[1:])
    out = RC.recipe_replay(table(spark, sf, "events"), RC.recipe_steps(spark, base, "events"))
    logged = RC.recipe_info(spark, base).where("table = 'events'").select("steps")
    return r4(attach_scalars(out, logged))


@register("s19_recipe_replay", _replay_sql(EVENTS_NULLS))
def s19_recipe_replay(spark, sf):
    base = scratch_dir(spark, "recipes")
    RC.recipe_append(spark, base, "events", _RECIPE)
    steps = RC.recipe_steps(spark, base, "events")
    return r4(RC.recipe_replay(events_nulls(spark, sf), steps))


@register("s20_refresh_slice", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'""")
def s20_refresh_slice(spark, sf):
    return SF.refresh_slice(table(spark, sf, "events"), "ts", "2024-01-20 00:00:00", "2024-01-25 12:00:00",
                            period_days=3, rolling=True)


@register("s20_refresh_slice_fixed", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'""")
def s20_refresh_slice_fixed(spark, sf):
    return SF.refresh_slice(table(spark, sf, "events"), "ts", "2024-01-20 00:00:00", "2024-01-25 12:00:00",
                            period_days=3, rolling=False)


@register("s20_refresh_table", """
SELECT user_id, round(sum(value), 4) AS total, count(*)::BIGINT AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00' AND value > 20 GROUP BY user_id""")
def s20_refresh_table(spark, sf):
    """An earlier window is stored, then re-fetched from further back, the recipe replayed and the table replaced."""
    from ..plans.recipe import recipe_append, step
    base, ev = scratch_dir(spark, "refresh"), table(spark, sf, "events")
    recipe_append(spark, base, "ev", [step("filter", conditions={"c1": ["value", ">", 20]})])
    SF.refresh_table(spark, ev, base, "ev", "ts", "2024-01-20 00:00:00", "2024-01-21 00:00:00")
    now = SF.refresh_table(spark, ev, base, "ev", "ts", "2024-01-20 00:00:00", "2024-01-25 12:00:00", period_days=3, rolling=True)
    return r4(now.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("n")))


@register("s21_upsert_latest", """
WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, 0 AS prio FROM orders
           WHERE o_orderdate < TIMESTAMP '1998-01-01'),
u AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, 1 AS prio FROM orders
      WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
b AS (SELECT * FROM t UNION ALL SELECT * FROM u)
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, prio DESC, o_orderkey DESC,
                               o_totalprice DESC) AS r FROM b) WHERE r = 1""")
def s21_upsert_latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    target = o.where("o_orderdate < timestamp_ntz'1998-01-01'")
    updates = o.where("o_orderdate >= timestamp_ntz'1998-01-01'")
    return MT.upsert_latest(target, updates, "o_custkey", "o_orderdate")


@register("s22_delete_where", """
SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def s22_delete_where(spark, sf):
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return MT.delete_where(table(spark, sf, "orders"), "o_custkey", building)


@register("s06_read_csv_uri", _TYPED_SQL.replace("SELECT l_orderkey, l_linenumber,",
                                                 "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,"))
def s06_read_csv_uri(spark, sf):
    from .._fs import hadoop_path
    path = scratch_dir(spark, "csv-uri")
    _dirty_lineitem(spark, sf).write.option("header", True).csv(path)
    fs, hpath = hadoop_path(spark, path)
    uri = fs.makeQualified(hpath).toUri().toString()  # scheme://authority/path, as a URL source would give
    df, _ = SF.read_csv(spark, uri)
    return r4(df)
