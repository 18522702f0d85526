"""File, object-store, JDBC and sensor sources (S-01, S-03 .. S-07, S-20).

All readers are ``spark.read`` calls on Hadoop-readable URIs; nothing is
downloaded to a local folder.  Type inference after a CSV read is the one-pass
content inference of ``operators.cleaning`` (Spark's ``inferSchema`` would
cost a full extra scan and knows no currency or yes/no rules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import clean_table


class EmptyTable(ValueError):
    pass


def read_csv(spark: SparkSession, paths, clean: bool = True, sep: str = ",", refuse_empty: bool = True,
             multi_line: bool | None = None):
    """S-01 / S-06: header CSV (local, HDFS, object store or HTTP-mounted URI).

    Every column is read as text, then one aggregate pass infers types.
    Returns ``(df, log)``; an empty file is refused.  Quoting is RFC 4180:
    doubled quotes, line breaks inside quotes.  The latter need whole files per
    task, so by default the lines are looked at first: unless one has an odd
    number of quotes, every record is one line and Spark splits large files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(paths).where(quotes % 2 == 1).isEmpty()
    raw = (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
           .option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line).csv(paths))
    if refuse_empty and raw.isEmpty():
        raise EmptyTable("the uploaded table is empty")
    if not clean:
        return raw, []
    return clean_table(raw)


def object_uri(provider: str, bucket: str, key: str, account: str | None = None) -> str:
    """S-05: URI of an object for the Hadoop connectors (s3a / abfss / gs)."""
    key = key.lstrip("/")
    if provider in ("s3", "aws", "s3a"):
        return f"s3a://{bucket}/{key}"
    if provider in ("azure", "abfs", "abfss"):
        if not account:
            raise ValueError("azure needs the storage account name")
        return f"abfss://{bucket}@{account}.dfs.core.windows.net/{key}"
    if provider in ("gcs", "gs", "google"):
        return f"gs://{bucket}/{key}"
    raise ValueError(f"unknown provider {provider!r}")


def read_object(spark: SparkSession, provider: str, bucket: str, key: str, account: str | None = None):
    """S-05: CSV object from a bucket (credentials come from the Hadoop configuration)."""
    return read_csv(spark, object_uri(provider, bucket, key, account))


def read_json_records(spark: SparkSession, paths, schema=None, flatten: bool = True,
                      multi_line: bool = False) -> DataFrame:
    """S-03: landed JSON API payloads → flat table.

    JSON lines (a record or an array of records a line) split within a file;
    ``multi_line`` reads pretty-printed documents and arrays, a file per task.

    Struct fields become ``parent_child`` columns; arrays of structs are
    exploded (outer) one level at a time."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("multiLine", multi_line)
    df = reader.schema(schema).json(paths) if schema is not None else reader.json(paths)
    return flatten_frame(df) if flatten else df


def flatten_frame(df: DataFrame, sep: str = "_") -> DataFrame:
    """Flatten nested structs and explode arrays until the schema is flat."""
    while True:
        fields = df.schema.fields
        structs = [f for f in fields if isinstance(f.dataType, T.StructType)]
        arrays = [f for f in fields if isinstance(f.dataType, T.ArrayType)
                  and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType))]
        if not structs and not arrays:
            return df
        if structs:
            cols = []
            for f in fields:
                if isinstance(f.dataType, T.StructType):
                    cols += [F.col(f"`{f.name}`.`{s.name}`").alias(f"{f.name}{sep}{s.name}")
                             for s in f.dataType.fields]
                else:
                    cols.append(F.col(f"`{f.name}`"))
            df = df.select(*cols)
            continue
        a = arrays[0]
        df = df.withColumn(a.name, F.explode_outer(F.col(f"`{a.name}`")))


def jdbc_options(url: str, query: str | None = None, table: str | None = None, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None, partitions: int | None = None,
                 user: str | None = None, password: str | None = None, driver: str | None = None,
                 fetchsize: int = 10000) -> dict:
    """S-04: options of a partitioned JDBC read (parallel range scans)."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query / table")
    opts = {"url": url, "fetchsize": str(fetchsize)}
    if partition_column:
        # Spark's partitioned read needs dbtable; a query is wrapped as a derived table
        opts["dbtable"] = table or f"({query}) q"
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(partitions or 8))
    elif query is not None:
        opts["query"] = query
    else:
        opts["dbtable"] = table
    if user:
        opts["user"] = user
    if password:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    return opts


def read_jdbc(spark: SparkSession, url: str, **kw) -> DataFrame:
    """S-04: SQL database query → DataFrame (predicate pushdown by the source)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **kw)).load()


def write_devices(df: DataFrame, path: str, ts: str = "ts", device: str = "device_id", mode: str = "append"):
    """Sensor readings stored partitioned by day, so device/time reads prune files."""
    (df.withColumn("day", F.to_date(F.col(ts))).write.mode(mode).partitionBy("day").parquet(path))
    return path


def read_devices(spark_or_df, base=None, devices=None, sensors=None, start=None, end=None,
                 ts: str = "ts", device: str = "device_id") -> DataFrame:
    """S-07: one scan of many devices' readings between ``start`` and ``end``.

    ``base`` is a day-partitioned dataset (``write_devices``) or a DataFrame;
    the time predicate prunes partitions and is pushed to Parquet, the device
    list becomes an ``IN`` filter, and the device column comes first."""
    if isinstance(spark_or_df, DataFrame):
        df = spark_or_df
    else:
        df = spark_or_df.read.parquet(base)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
        if "day" in df.columns:
            cond = cond & (F.col("day") >= F.to_date(F.lit(start)))
    if end is not None:
        cond = cond & (F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
        if "day" in df.columns:
            cond = cond & (F.col("day") <= F.to_date(F.lit(end)))
    if devices is not None:
        cond = cond & F.col(device).isin(list(devices))
    sensors = sensors or [c for c in df.columns if c not in (device, ts, "day")]
    return df.where(cond).select(device, ts, *sensors)


def refresh_slice(df: DataFrame, ts: str, start, now, period_days: int = 0, rolling: bool = False) -> DataFrame:
    """S-20: the re-fetch window: [start − period, now] when rolling, else [start, now]."""
    t = F.col(ts)
    lo = F.lit(start).cast(df.schema[ts].dataType)
    if rolling:
        lo = lo - F.expr(f"INTERVAL {int(period_days)} DAYS")
    return df.where((t >= lo) & (t <= F.lit(now).cast(df.schema[ts].dataType)))


def refresh_table(spark: SparkSession, source: DataFrame, base: str, name: str, ts: str, start, now, period_days: int = 0,
                  rolling: bool = False, steps=None) -> DataFrame:
    """S-20: fetch the window, replay the table's stored recipe (or ``steps``) on it and put the result in the table's place.

    The table is created if it is missing; readers see the old content or the new one."""
    from ..plans.recipe import recipe_replay, recipe_steps
    from . import tables

    fresh = refresh_slice(source, ts, start, now, period_days, rolling)
    fresh = recipe_replay(fresh, recipe_steps(spark, base, name) if steps is None else steps)
    if tables.exists(spark, tables.table_path(base, name)):
        tables.update_table(fresh, base, name)
    else:
        tables.create_table(fresh, base, name, clean=False)
    return tables.read_table(spark, base, name)
