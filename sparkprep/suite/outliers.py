"""Checked queries for outliers and class balance (O-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as OL
from .base import EVENTS_NULLS, events_nulls, r4, register, table

_IQR = """(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {src} s))"""


@register("o01_outliers_iqr", f"""
SELECT e.* FROM events e, {_IQR.format(src='events')} b WHERE e.value < b.lo OR e.value > b.hi""")
def o01_outliers_iqr(spark, sf):
    return OL.outliers_iqr(table(spark, sf, "events"), "value")


@register("o02_outliers_zscore", """
WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events)
SELECT e.*, round((e.value - s.mu) / s.sd, 4) AS "Z-score" FROM events e, s
WHERE abs((e.value - s.mu) / s.sd) > 3""")
def o02_outliers_zscore(spark, sf):
    return r4(OL.outliers_zscore(table(spark, sf, "events"), "value"))


@register("o03_drop_outliers", f"""
SELECT e.* FROM {EVENTS_NULLS} e, {_IQR.format(src=EVENTS_NULLS)} b
WHERE NOT coalesce(e.value < b.lo OR e.value > b.hi, false)""")
def o03_drop_outliers(spark, sf):
    return OL.drop_outliers(events_nulls(spark, sf), "value", "iqr")


@register("o03_drop_outliers_zscore", f"""
WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM {EVENTS_NULLS} x)
SELECT e.* FROM {EVENTS_NULLS} e, s WHERE NOT coalesce(abs((e.value - s.mu) / s.sd) > 3, false)""")
def o03_drop_outliers_zscore(spark, sf):
    return OL.drop_outliers(events_nulls(spark, sf), "value", "zscore")


_UNDER = """(SELECT * FROM labels WHERE toxic = {cls}
   ORDER BY md5(doc_id::VARCHAR || ':10'), doc_id LIMIT {n})"""
_OVER = """(WITH m AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM labels WHERE toxic = {cls}),
       d AS (SELECT (('0x' || substr(md5(range::VARCHAR || ':10'), 1, 15))::BIGINT)
                    % (SELECT count(*) FROM m) AS idx FROM range({n}))
   SELECT m.doc_id, m.quality, m.toxic FROM d JOIN m USING (idx))"""


@register("o04_undersample", f"""
SELECT * FROM labels WHERE toxic <> 0 UNION ALL SELECT * FROM {_UNDER.format(cls=0, n=50)}""")
def o04_undersample(spark, sf):
    return OL.undersample(table(spark, sf, "labels"), "toxic", 0, 50, "doc_id", seed=10)


@register("o05_oversample", f"""
SELECT * FROM labels WHERE toxic <> 1 UNION ALL SELECT * FROM {_OVER.format(cls=1, n=300)}""")
def o05_oversample(spark, sf):
    return OL.oversample(table(spark, sf, "labels"), "toxic", 1, 300, "doc_id", seed=10)


_N1 = "(SELECT count(*) FROM labels WHERE toxic = 1)"


@register("o06_resample_classes", f"""
SELECT * FROM (SELECT * FROM labels WHERE toxic = 0 ORDER BY md5(doc_id::VARCHAR || ':10'), doc_id
               LIMIT (SELECT 3 * count(*) FROM labels WHERE toxic = 1))
UNION ALL
SELECT * FROM (WITH m AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM labels WHERE toxic = 1),
       d AS (SELECT (('0x' || substr(md5(j::VARCHAR || ':10'), 1, 15))::BIGINT) % (SELECT count(*) FROM m) AS idx
             FROM (SELECT unnest(range(0, 2 * {_N1})) AS j))
   SELECT m.doc_id, m.quality, m.toxic FROM d JOIN m USING (idx))""")
def o06_resample_classes(spark, sf):
    labels = table(spark, sf, "labels")
    n1 = labels.where("toxic = 1").count()  # the plan is relative to the minority size
    return OL.resample_classes(labels, "toxic", {0: (3 * n1, False), 1: (2 * n1, True)}, "doc_id")


@register("o07_smote_nc")
def o07_smote_nc(spark, sf):
    from ..ml.smote import smote_nc
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                               "lang", "source")
    data = lab.join(doc, "doc_id").select("doc_id", "n_chars", "quality", "lang", "source", "toxic")
    return smote_nc(data, "toxic", "doc_id", k=5, seed=10, numeric=["n_chars", "quality"],
                    categorical=["lang", "source"])
