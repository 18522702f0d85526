"""Checked queries for resampling and time-series statistics (W-05 .. W-14, F-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as TS
from .base import r4, register, table


def _resample_sql(width_us: int, fn: str) -> str:
    agg = {"mean": "avg(value)", "min": "min(value)", "max": "max(value)",
           "first": "arg_min(value, ts) FILTER (WHERE value IS NOT NULL)",
           "last": "arg_max(value, ts) FILTER (WHERE value IS NOT NULL)"}[fn]
    return f"""
WITH o AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS o FROM events),
b AS (SELECT floor(date_diff('microsecond', o.o, e.ts) / {width_us})::BIGINT AS bin, e.ts, e.value
      FROM events e, o),
g AS (SELECT bin, {agg} AS value FROM b GROUP BY bin),
s AS (SELECT range AS bin FROM range((SELECT min(bin) FROM b), (SELECT max(bin) + 1 FROM b)))
SELECT o.o + to_microseconds(s.bin * {width_us}) AS ts, round(g.value, 4) AS value
FROM s CROSS JOIN o LEFT JOIN g ON s.bin = g.bin"""


@register("w05_resample_minutes", _resample_sql(10 * 60 * 1_000_000, "mean"))
def w05_resample_minutes(spark, sf):
    ev = table(spark, sf, "events").select("ts", "value")
    return r4(TS.resample(ev, "ts", 10, "minute", "mean"))


@register("w05_resample_seconds", _resample_sql(45 * 1_000_000, "max"))
def w05_resample_seconds(spark, sf):
    ev = table(spark, sf, "events").select("ts", "value")
    return r4(TS.resample(ev, "ts", 45, "second", "max"))


@register("w05_resample_hours", _resample_sql(3 * 3600 * 1_000_000, "last"))
def w05_resample_hours(spark, sf):
    ev = table(spark, sf, "events").select("ts", "value")
    return r4(TS.resample(ev, "ts", 3, "hour", "last"))


@register("w07_resample_days_first", _resample_sql(2 * 86400 * 1_000_000, "first"))
def w07_resample_days_first(spark, sf):
    ev = table(spark, sf, "events").select("ts", "value")
    return r4(TS.resample(ev, "ts", 2, "day", "first"))


@register("w07_resample_ties", """
WITH o AS (SELECT last_day(o_orderdate)::DATE AS d, o_orderkey, o_totalprice FROM orders),
b AS (SELECT d, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM o GROUP BY d),
s AS (SELECT range::DATE AS d FROM range((SELECT min(d) FROM b)::TIMESTAMP, (SELECT max(d) FROM b)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))
SELECT s.d::TIMESTAMP AS ts, round(b.first, 4) AS o_totalprice_first, round(b.last, 4) AS o_totalprice_last FROM s LEFT JOIN b USING (d)""")
def w07_resample_ties(spark, sf):
    """Every order of a month at the same time: a key says which row is the first and which the last."""
    o = table(spark, sf, "orders").select(F.last_day("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey", "o_totalprice")
    return r4(TS.resample(o, "ts", 1, "day", ["first", "last"], ["o_totalprice"], order_by="o_orderkey"))


@register("w07_resample_days_min", _resample_sql(86400 * 1_000_000, "min"))
def w07_resample_days_min(spark, sf):
    ev = table(spark, sf, "events").select("ts", "value")
    return r4(TS.resample(ev, "ts", 1, "day", "min"))


def _month_sql(n: int, fn: str) -> str:
    agg = {"mean": "avg(o_totalprice)", "max": "max(o_totalprice)", "min": "min(o_totalprice)"}[fn]
    return f"""
WITH p AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS p, o_totalprice FROM orders),
p0 AS (SELECT min(p) AS p0 FROM p),
b AS (SELECT ceil((p - p0) / {n})::BIGINT AS bin, o_totalprice FROM p, p0),
g AS (SELECT bin, {agg} AS o_totalprice FROM b GROUP BY bin),
s AS (SELECT range AS bin FROM range((SELECT min(bin) FROM b), (SELECT max(bin) + 1 FROM b)))
SELECT last_day(make_date(((p0 + s.bin * {n}) // 12)::BIGINT, ((p0 + s.bin * {n}) % 12 + 1)::BIGINT, 1))::TIMESTAMP
       AS o_orderdate, round(g.o_totalprice, 4) AS o_totalprice
FROM s CROSS JOIN p0 LEFT JOIN g ON s.bin = g.bin"""


@register("w06_resample_month", _month_sql(1, "mean"))
def w06_resample_month(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    return r4(TS.resample(o, "o_orderdate", 1, "month", "mean"))


@register("w06_resample_two_months", _month_sql(2, "max"))
def w06_resample_two_months(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    return r4(TS.resample(o, "o_orderdate", 2, "month", "max"))


@register("w06_resample_years", """
WITH p AS (SELECT year(o_orderdate) AS p, o_totalprice FROM orders),
p0 AS (SELECT min(p) AS p0 FROM p),
b AS (SELECT ceil((p - p0) / 2)::BIGINT AS bin, o_totalprice FROM p, p0),
g AS (SELECT bin, min(o_totalprice) AS o_totalprice FROM b GROUP BY bin),
s AS (SELECT range AS bin FROM range((SELECT min(bin) FROM b), (SELECT max(bin) + 1 FROM b)))
SELECT make_timestamp((p0 + s.bin * 2)::BIGINT, 12, 31, 0, 0, 0) AS o_orderdate,
       round(g.o_totalprice, 4) AS o_totalprice
FROM s CROSS JOIN p0 LEFT JOIN g ON s.bin = g.bin""")
def w06_resample_years(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    return r4(TS.resample(o, "o_orderdate", 2, "year", "min"))


@register("w09_infer_frequency", """
WITH f AS (SELECT min(ts) AS first_ts FROM events),
s AS (SELECT min(ts) AS second_ts FROM events, f WHERE ts > f.first_ts)
SELECT first_ts, second_ts, date_diff('microsecond', first_ts, second_ts) / 1e6 AS seconds,
  CASE WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 1 THEN 'S'
       WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 60 THEN 'T'
       WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 3600 THEN 'H'
       WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 86400 THEN 'D'
       WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 604800 THEN 'W'
       WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 2678400 THEN 'M'
       WHEN date_diff('microsecond', first_ts, second_ts) / 1e6 <= 31536000 THEN 'Y' ELSE 'D' END AS freq
FROM f, s""")
def w09_infer_frequency(spark, sf):
    return TS.infer_frequency(table(spark, sf, "events"), "ts")


def _monthly_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    return TS.resample(o, "o_orderdate", 1, "month", "mean")


_MONTHLY_SQL = """(SELECT make_date(year(o_orderdate)::BIGINT, month(o_orderdate)::BIGINT, 1) AS m,
   avg(o_totalprice) AS y FROM orders GROUP BY 1)"""


def _decompose_sql(mult: bool) -> str:
    det = "y / trend" if mult else "y - trend"
    norm = "pm / (SELECT avg(pm) FROM ph)" if mult else "pm - (SELECT avg(pm) FROM ph)"
    resid = "y / (trend * seasonal)" if mult else "y - trend - seasonal"
    return f"""
WITH s AS (SELECT m, y, row_number() OVER (ORDER BY m) - 1 AS i FROM {_MONTHLY_SQL} x),
t AS (SELECT m, y, i, CASE WHEN count(*) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
        THEN (sum(y) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
              - 0.5 * lag(y, 6) OVER (ORDER BY i) - 0.5 * lead(y, 6) OVER (ORDER BY i)) / 12 END AS trend FROM s),
ph AS (SELECT i % 12 AS phase, avg({det}) AS pm FROM t GROUP BY 1),
sn AS (SELECT phase, {norm} AS seasonal FROM ph)
SELECT last_day(m)::TIMESTAMP AS o_orderdate, round(y, 4) AS observed, round(trend, 4) AS trend,
       round(seasonal, 4) AS seasonal, round({resid}, 4) AS resid
FROM t JOIN sn ON t.i % 12 = sn.phase"""


@register("w10_decompose_additive", _decompose_sql(False))
def w10_decompose_additive(spark, sf):
    return r4(TS.decompose(_monthly_orders(spark, sf), "o_totalprice", "o_orderdate", 12, "additive"))


@register("w10_decompose_multiplicative", _decompose_sql(True))
def w10_decompose_multiplicative(spark, sf):
    return r4(TS.decompose(_monthly_orders(spark, sf), "o_totalprice", "o_orderdate", 12, "multiplicative"))


def _acf_sql(lags: int) -> str:
    lag_cols = ", ".join(f"lag(value, {k}) OVER (ORDER BY ts, event_id) AS l{k}" for k in range(1, lags + 1))
    parts = ["SELECT 0 AS lag, 1.0::DOUBLE AS acf"]
    for k in range(1, lags + 1):
        parts.append(f"SELECT {k}, round(sum((value - mu) * (l{k} - mu)) / (SELECT sum((value - mu) * (value - mu)) "
                     f"FROM x, m), 4) FROM x, m")
    return (f"WITH x AS (SELECT value, {lag_cols} FROM events), m AS (SELECT avg(value) AS mu FROM events)\n"
            + "\nUNION ALL\n".join(parts))


@register("w11_acf", _acf_sql(20))
def w11_acf(spark, sf):
    return r4(TS.acf(table(spark, sf, "events"), "value", ["ts", "event_id"], 20, chunk_rows=4096))


@register("w12_pacf")
def w12_pacf(spark, sf):
    return TS.pacf(table(spark, sf, "events"), "value", ["ts", "event_id"], 20, chunk_rows=4096)


@register("w12_pacf_short", f"""
WITH r AS ({_acf_sql(3)}),
a AS (SELECT max(CASE WHEN lag = 1 THEN acf END) AS r1, max(CASE WHEN lag = 2 THEN acf END) AS r2, max(CASE WHEN lag = 3 THEN acf END) AS r3 FROM r)
SELECT 0 AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT 1, round(r1, 3) FROM a UNION ALL SELECT 2, round((r2 - r1 * r1) / (1 - r1 * r1), 3) FROM a
UNION ALL SELECT 3, round((r3 - 2 * r1 * r2 + r1 * r1 * r1 + r1 * r2 * r2 - r1 * r1 * r3) / (1 - 2 * r1 * r1 + 2 * r1 * r1 * r2 - r2 * r2), 3) FROM a""")
def w12_pacf_short(spark, sf):
    """Three lags, against the closed forms of Yule and Walker."""
    got = TS.pacf(table(spark, sf, "events"), "value", ["ts", "event_id"], 3)
    return got.select("lag", F.round("pacf", 3).alias("pacf"))


@register("w13_adf_no_lags", """
WITH s AS (SELECT value AS y, lag(value) OVER (ORDER BY ts, event_id) AS x FROM events),
r AS (SELECT count(*) AS n, regr_slope(y - x, x) AS b, regr_sxx(y - x, x) AS sxx, regr_syy(y - x, x) AS syy FROM s WHERE x IS NOT NULL)
SELECT round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 3) AS statistic, 0 AS used_lag, n::BIGINT AS nobs FROM r""")
def w13_adf_no_lags(spark, sf):
    """All events, without lagged differences: one slope and its error."""
    got = TS.adf(table(spark, sf, "events"), "value", ["ts", "event_id"], max_lag=0)
    return got.select(F.round("statistic", 3).alias("statistic"), "used_lag", "nobs")


@register("w13_adf")
def w13_adf(spark, sf):
    return TS.adf(_monthly_orders(spark, sf), "o_totalprice", "o_orderdate")


@register("w14_last_years", """
SELECT * FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 2 YEAR FROM orders)""")
def w14_last_years(spark, sf):
    return TS.last_years(table(spark, sf, "orders"), "o_orderdate", 2)


@register("f04_future_axis", """
SELECT range AS step, (SELECT max(ts) FROM events) + range * INTERVAL 1 DAY AS ts FROM range(1, 8)""")
def f04_future_axis(spark, sf):
    return TS.future_axis(table(spark, sf, "events"), "ts", 7, "D")


@register("f04_future_axis_month", """
SELECT range AS step, last_day((SELECT max(o_orderdate) FROM orders) + range * INTERVAL 1 MONTH)::TIMESTAMP
  AS o_orderdate FROM range(1, 7)""")
def f04_future_axis_month(spark, sf):
    return TS.future_axis(table(spark, sf, "orders"), "o_orderdate", 6, "M")
