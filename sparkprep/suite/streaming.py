"""Checked queries for incremental streaming (T-*).

The events table is landed as day-partitioned files in two deliveries under a
fresh folder of the shared checkpoint directory; the stream runs once per
delivery with ``availableNow`` and the same checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .._fs import scratch_dir
from ..streaming.refresh import run_to_table, stream_refresh, stream_resample
from .base import register, table

_SPLIT = "2024-01-16"


def _land(spark, sf, src, first: bool):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    part = ev.where(F.col("day") < F.lit(_SPLIT)) if first else ev.where(F.col("day") >= F.lit(_SPLIT))
    part.write.mode("append").partitionBy("day").parquet(src)
    return ev.schema


@register("t01_stream_refresh", "SELECT * FROM events")
def t01_stream_refresh(spark, sf):
    src, dst, ck = scratch_dir(spark, "t01-src"), scratch_dir(spark, "t01-dst"), scratch_dir(spark, "t01-ck")
    cols = table(spark, sf, "events").columns
    for first in (True, False):  # two deliveries, two incremental runs
        schema = _land(spark, sf, src, first)
        stream_refresh(spark, src, dst, ck, schema, transform=lambda s: s.select(*cols))
    return spark.read.parquet(dst)


@register("t02_stream_resample", """
WITH b AS (SELECT make_timestamp((floor(epoch_us(ts) / 600000000) * 600000000)::BIGINT) AS ts, value FROM events)
SELECT ts, round(avg(value), 4) AS value FROM b GROUP BY ts
HAVING ts + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def t02_stream_resample(spark, sf):
    src, dst, ck = scratch_dir(spark, "t02-src"), scratch_dir(spark, "t02-dst"), scratch_dir(spark, "t02-ck")
    for first in (True, False):
        schema = _land(spark, sf, src, first)
        sdf = spark.readStream.schema(schema).parquet(src).select("ts", "value")
        run_to_table(stream_resample(sdf, "ts", 10, "minute", "mean", delay="1 hour"), dst, ck)
    out = spark.read.parquet(dst)
    return out.select("ts", F.round("value", 4).alias("value"))
