"""Checked queries for cleaning and type inference (S-08 .. S-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators.cleaning import clean_table, infer_types
from .base import r4, register, table


def _dirty_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit(" $"), F.col("l_extendedprice").cast("string")).alias("price_txt"),
        F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%")).alias("disc_txt"),
        F.concat(F.lit("("), F.col("l_quantity").cast("string"), F.lit(")")).alias("qty_txt"),
        F.when(F.col("l_returnflag") == "R", F.lit(" yes ")).otherwise(F.lit("No")).alias("flag_txt"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_txt"),
        F.col("l_suppkey").cast("string").alias("supp_txt"),
        F.col("l_returnflag").alias("status"))


_TYPED_SQL = """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price_txt,
  round(l_discount * 100, 4) AS disc_txt, round(l_quantity, 4) AS qty_txt, l_returnflag = 'R' AS flag_txt,
  date_trunc('day', l_shipdate)::TIMESTAMP AS ship_txt, l_suppkey AS supp_txt, l_returnflag AS status
FROM lineitem"""


@register("s09_infer_types", _TYPED_SQL)
def s09_infer_types(spark, sf):
    typed, _ = infer_types(_dirty_lineitem(spark, sf))
    return r4(typed)


@register("s10_parse_numeric", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price, round(l_quantity, 4) AS qty,
       round(-l_tax, 4) + 0.0 AS neg_tax FROM lineitem""")
def s10_parse_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    return r4(li.select(
        "l_orderkey", "l_linenumber",
        P.parse_numeric(F.concat(F.lit(" $"), F.col("l_extendedprice").cast("string"))).alias("price"),
        P.parse_numeric(F.concat(F.lit("("), F.col("l_quantity").cast("string"), F.lit(")"))).alias("qty"),
        P.parse_numeric(F.concat(F.lit("−"), F.col("l_tax").cast("string"))).alias("neg_tax")))


@register("s11_parse_datetime", """
SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day_iso,
       date_trunc('day', o_orderdate)::TIMESTAMP AS day_us, NULL::TIMESTAMP AS wrong_fmt FROM orders""")
def s11_parse_datetime(spark, sf):
    o = table(spark, sf, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    us = F.date_format("o_orderdate", "MM/dd/yyyy")
    return o.select("o_orderkey", P.parse_datetime(iso, "yyyy-MM-dd").alias("day_iso"),
                    P.parse_datetime(us, "MM/dd/yyyy").alias("day_us"),
                    P.parse_datetime(iso, "dd/MM/yyyy HH:mm:ss").alias("wrong_fmt"))


@register("s11_datetime_formats", """
SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS named, (date_trunc('day', o_orderdate) + INTERVAL 13 HOUR + INTERVAL 5 MINUTE)::TIMESTAMP AS
       twelve, (date_trunc('day', o_orderdate) - INTERVAL 330 MINUTE)::TIMESTAMP AS zoned, date_trunc('day', o_orderdate)::TIMESTAMP AS day_first FROM orders""")
def s11_datetime_formats(spark, sf):
    """Month names, twelve hours, a zone and days before months, each found by inference over the whole column."""
    o = table(spark, sf, "orders").withColumn("d", F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    text = o.select("o_orderkey", F.date_format("d", "dd MMM yyyy").alias("named"), F.concat(F.date_format("d", "MM/dd/yyyy"), F.lit(" 01:05 PM")).alias("twelve"),
                    F.concat(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("zoned"), F.date_format("d", "dd/MM/yyyy").alias("day_first"))
    return infer_types(text)[0]


@register("s12_parse_boolean", """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false ELSE NULL END AS done
FROM orders""")
def s12_parse_boolean(spark, sf):
    o = table(spark, sf, "orders")
    txt = (F.when(F.col("o_orderstatus") == "F", F.lit(" Yes")).when(F.col("o_orderstatus") == "O", F.lit("n"))
           .otherwise(F.lit("maybe")))
    return o.select("o_orderkey", P.parse_boolean(txt).alias("done"))


def _dirty_events(spark, sf):
    ev = table(spark, sf, "events")
    gone = F.col("event_id") % 97 == 0
    def z(c):
        return F.when(gone, F.lit(None)).otherwise(c)
    return ev.select(
        z(F.col("event_id").cast("string")).alias(" Event ID "),
        z(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Time-Stamp"),
        z(F.col("user_id")).alias("User.Id"),
        z(F.col("event_type")).alias("Event Type"),
        z(F.concat(F.lit("$"), F.col("value").cast("string"))).alias("Value ($)"),
        F.lit(None).cast("string").alias("Empty"))


@register("s08_clean_table", """
SELECT event_id AS "event id", date_trunc('second', ts)::TIMESTAMP AS "time_stamp", user_id AS "user_id",
       event_type AS "event type", round(value, 4) AS "value ___"
FROM events WHERE event_id % 97 <> 0""")
def s08_clean_table(spark, sf):
    df, _ = clean_table(_dirty_events(spark, sf))
    return r4(df)
