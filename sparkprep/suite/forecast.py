"""Forecast queries (F-01, F-02, F-03, F-05): rows-only plus property tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import forecast as FC
from .base import register, table


def monthly_panel(spark, sf):
    """Monthly mean order value per market segment (a keyed panel)."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return (j.groupBy("c_mktsegment", F.last_day("o_orderdate").cast("timestamp_ntz").alias("month"))
            .agg(F.avg("o_totalprice").alias("value")))


def daily_panel(spark, sf):
    """Daily mean event value per event type."""
    ev = table(spark, sf, "events")
    return (ev.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
            .agg(F.avg("value").alias("value")))


@register("f01_forecast_ar")
def f01_forecast_ar(spark, sf):
    return FC.forecast_ar(monthly_panel(spark, sf), "month", "value", m=12, horizon=6, key="c_mktsegment",
                          freq="M")


@register("f02_forecast_trend_seasonal")
def f02_forecast_trend_seasonal(spark, sf):
    return FC.forecast_trend_seasonal(daily_panel(spark, sf), "day", "value", horizon=7, key="event_type", freq="D")


@register("f03_forecast_windows")
def f03_forecast_windows(spark, sf):
    return FC.forecast_windows(monthly_panel(spark, sf), "month", "value", length=12, horizon=6,
                               key="c_mktsegment", freq="M")


@register("f01_forecast_series", """
WITH e AS (SELECT CASE WHEN user_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN user_id % 3 <> 0 THEN (user_id % 2)::VARCHAR END AS half,
                  date_trunc('day', ts) AS day FROM events),
s AS (SELECT kind, half, max(day) AS last FROM e GROUP BY kind, half)
SELECT kind, half, range::INT AS step, (last + range * INTERVAL 1 DAY)::TIMESTAMP AS day FROM s, range(1, 4)""")
def f01_forecast_series(spark, sf):
    """Series of two keys, either of which may be null: each keeps its own forecast and time axis."""
    e = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("kind"),
        F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 2).cast("string")).alias("half"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "value")
    daily = e.groupBy("kind", "half", "day").agg(F.avg("value").alias("value"))
    fc = FC.forecast_ar(daily, "day", "value", m=7, horizon=3, key=["kind", "half"], max_p=3)
    return fc.where("forecast IS NOT NULL AND NOT isnan(forecast)").select("kind", "half", "step", "day")


@register("f05_backtest")
def f05_backtest(spark, sf):
    return FC.backtest(monthly_panel(spark, sf), "month", "value", "ar", 0.2, key="c_mktsegment", freq="M", m=12)
