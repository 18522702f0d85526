"""Incremental refresh and streaming resample (T-01, T-02).

The reference re-fetches sensor data on a schedule and replays the table's
recipe.  The Spark form is a file-source stream run with
``trigger(availableNow=True)``: each run processes only files it has not seen
(the checkpoint remembers them), applies the same lazy transformation, and
appends to the target; a failed run resumes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import UNIT_SECONDS


def stream_refresh(spark: SparkSession, src: str, dst: str, checkpoint: str, schema, transform=None,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None) -> str:
    """T-01: process new files of ``src`` into ``dst`` (append), then stop."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    sdf = reader.load(src)
    if transform is not None:
        sdf = transform(sdf)
    q = (sdf.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(dst))
    q.awaitTermination()
    return dst


def window_offset(origin: str, width_seconds: int) -> str:
    """``startTime`` that aligns tumbling windows to ``origin`` (pandas' first-day midnight)."""
    import datetime as dt
    o = dt.datetime.fromisoformat(origin)
    secs = int((o - dt.datetime(1970, 1, 1)).total_seconds()) % width_seconds
    return f"{secs} seconds"


def stream_resample(sdf: DataFrame, ts: str, every: int, unit: str, fn: str = "mean", cols=None,
                    delay: str = "1 hour", origin: str = "1970-01-01 00:00:00") -> DataFrame:
    """T-02: tumbling-window resample of a stream with a watermark.

    Windows close when the watermark (max event time − ``delay``) passes their
    end; rows older than the watermark are dropped; no empty bins are emitted
    (there is no spine on an unbounded stream)."""
    width = every * UNIT_SECONDS[unit]
    cols = cols or [c for c in sdf.columns if c != ts]
    t = F.col(ts).cast("timestamp")  # watermarks need a time-zone-aware timestamp
    src = sdf.withColumn("__et", t)
    agg = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    if fn in agg:
        exprs = [agg[fn](F.col(c)).alias(c) for c in cols]
    elif fn in ("first", "last"):
        pick = F.min_by if fn == "first" else F.max_by
        exprs = [pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("__et"))).alias(c) for c in cols]
    else:
        raise ValueError(f"unknown resample function {fn!r}")
    out = (src.withWatermark("__et", delay)
           .groupBy(F.window("__et", f"{width} seconds", startTime=window_offset(origin, width)).alias("__w"))
           .agg(*exprs))
    label = F.col("__w.start").cast(sdf.schema[ts].dataType)
    return out.select(label.alias(ts), *cols)


def run_to_table(sdf: DataFrame, dst: str, checkpoint: str, mode: str = "append") -> str:
    """Run a streaming query over everything available into Parquet, then stop."""
    q = (sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(dst))
    q.awaitTermination()
    return dst
