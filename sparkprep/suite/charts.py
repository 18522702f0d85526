"""Checked queries for chart tables (C-*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import charts as C
from .base import r4, register, table


@register("c01_histogram", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(floor((value - lo) * 10 / (hi - lo)), 9)::INT AS bin, count(*) AS n FROM events, r GROUP BY 1),
s AS (SELECT range::INT AS bin FROM range(10))
SELECT s.bin, round(lo + (hi - lo) * s.bin / 10, 4) AS lo, round(lo + (hi - lo) * (s.bin + 1) / 10, 4) AS hi,
       coalesce(c.n, 0)::BIGINT AS count
FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin""")
def c01_histogram(spark, sf):
    return r4(C.histogram(table(spark, sf, "events"), "value", 10))


def _kde_sql(points: int) -> str:
    parts = []
    for k in range(points):
        g = f"(lo + (hi - lo) / {points - 1} * {k})"
        parts.append(f"SELECT {k} AS point, round({g}, 8) AS x, round(sum(exp(-pow({g} - value, 2) / (2 * h * h))) "
                     f"/ (n * h * {math.sqrt(2 * math.pi)!r}), 8) AS density FROM events, s GROUP BY lo, hi, h, n")
    return ("WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, "
            "stddev_samp(value) * pow(count(value)::DOUBLE, -0.2) AS h FROM events)\n" + "\nUNION ALL\n".join(parts))


@register("c02_kde", _kde_sql(50))
def c02_kde(spark, sf):
    return r4(C.kde(table(spark, sf, "events"), "value", 50), 8)


@register("c03_box_stats", """
WITH p AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM p)
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  min(CASE WHEN value >= lo AND value <= hi THEN value END) AS lower_whisker,
  max(CASE WHEN value >= lo AND value <= hi THEN value END) AS upper_whisker,
  count_if(value < lo OR value > hi)::BIGINT AS outliers
FROM events, b GROUP BY q1, median, q3""")
def c03_box_stats(spark, sf):
    return r4(C.box_stats(table(spark, sf, "events"), "value"))


@register("c04_category_counts", """
WITH c AS (SELECT o_orderpriority AS class, count(*)::BIGINT AS count FROM orders GROUP BY 1)
SELECT class, CASE WHEN length(class) > 11 THEN substr(class, 1, 8) || '...' ELSE class END AS label,
       count, round(count * 100.0 / (SELECT sum(count) FROM c), 2) AS percent FROM c""")
def c04_category_counts(spark, sf):
    return C.category_counts(table(spark, sf, "orders"), "o_orderpriority")


@register("c05_series", """
SELECT ts, 'value' AS series, value FROM events
UNION ALL SELECT ts, 'user_id', user_id::DOUBLE FROM events""")
def c05_series(spark, sf):
    return C.series(table(spark, sf, "events"), "ts", ["value", "user_id"])


@register("c06_histogram_sum", """
WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
c AS (SELECT least(floor((l_quantity - lo) * 10 / (hi - lo)), 9)::INT AS bin,
             sum(l_extendedprice) AS se, sum(l_tax) AS st FROM lineitem, r GROUP BY 1),
s AS (SELECT range::INT AS bin FROM range(10))
SELECT s.bin, round(lo + (hi - lo) * s.bin / 10, 4) AS lo, round(lo + (hi - lo) * (s.bin + 1) / 10, 4) AS hi,
       round(coalesce(se, 0), 4) AS sum_l_extendedprice, round(coalesce(st, 0), 4) AS sum_l_tax
FROM s CROSS JOIN r LEFT JOIN c ON s.bin = c.bin""")
def c06_histogram_sum(spark, sf):
    return r4(C.histogram_sum(table(spark, sf, "lineitem"), "l_quantity", ["l_extendedprice", "l_tax"], 10))


@register("c07_pie", """
WITH s AS (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT o_orderpriority, round(total, 4) AS total, round(total * 100.0 / (SELECT sum(total) FROM s), 4) AS percent
FROM s""")
def c07_pie(spark, sf):
    return r4(C.pie(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@register("c08_points", """
SELECT event_id, value, user_id, event_type FROM events""")
def c08_points(spark, sf):
    return C.points(table(spark, sf, "events"), ["value", "user_id"], "event_id", "event_type")


@register("c09_pair_points", """
SELECT event_id, 'value' AS x_col, 'user_id' AS y_col, value AS x, user_id::DOUBLE AS y FROM events""")
def c09_pair_points(spark, sf):
    return C.pair_points(table(spark, sf, "events"), ["value", "user_id"], "event_id")


def _pair_bins_sql(cols, bins):
    rng = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    b = ", ".join(f"least(floor(({c} - lo_{c}) * {bins} / (hi_{c} - lo_{c})), {bins - 1})::INT AS b_{c}" for c in cols)
    parts = []
    for i, a in enumerate(cols):
        for c in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS x_col, '{c}' AS y_col, b_{a} AS x_bin, b_{c} AS y_bin, count(*)::BIGINT "
                         f"AS count FROM bb GROUP BY 3, 4")
    return (f"WITH r AS (SELECT {rng} FROM lineitem), bb AS (SELECT {b} FROM lineitem, r)\n"
            + "\nUNION ALL\n".join(parts))


@register("c09_pair_bins", _pair_bins_sql(["l_quantity", "l_extendedprice", "l_discount"], 20))
def c09_pair_bins(spark, sf):
    return C.pair_bins(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 20)
