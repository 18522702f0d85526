"""Named-table storage: one Parquet dataset directory per table (S-02, S-13..S-16).

A *base* folder holds ``<name>.parquet`` datasets.  On a cluster the base is a
shared URI (``s3a://``, ``abfss://``, ``hdfs://``); all listing goes through
Spark's file index (``_metadata``) rather than a local ``os.listdir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normalise_name
from ..operators.relational import q


class TableExists(Exception):
    pass


class TableMissing(Exception):
    pass


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _hadoop_fs(spark, path)
    return bool(fs.exists(hpath))


def read_table(spark: SparkSession, base: str, name: str, missing_ok: bool = False) -> DataFrame:
    """S-02: read a named table; a missing table raises (or is empty if ``missing_ok``)."""
    path = table_path(base, name)
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], "value string").limit(0)
        raise TableMissing(name)
    return spark.read.parquet(path)


def table_name(file_name: str) -> str:
    """Name rule: text before the first '.'."""
    return file_name.split(".", 1)[0]


def create_table(df: DataFrame, base: str, name: str, clean: bool = True) -> str:
    """S-13: write a new table; refuse an existing name or an empty table."""
    from ..operators.cleaning import clean_table
    name = table_name(name)
    spark = df.sparkSession
    path = table_path(base, name)
    if exists(spark, path):
        raise TableExists(name)
    if df.isEmpty():
        raise ValueError("table is empty")
    if clean:
        df, _ = clean_table(df)
    df.write.mode("errorifexists").parquet(path)
    return path


def update_table(df: DataFrame, base: str, name: str) -> str:
    """S-14: overwrite an existing table.

    Spark cannot overwrite a path it is still reading, so the new content is
    written to a staging path first, then swapped in with two renames.  The
    side paths carry a fresh name per call.  If the second rename fails the old
    table is put back, and it is deleted only once the new one is in place.
    """
    spark = df.sparkSession
    path = table_path(base, name)
    if not exists(spark, path):
        raise TableMissing(name)
    tag = uuid.uuid4().hex
    staging = f"{path}.__staging-{tag}"
    df.write.mode("errorifexists").parquet(staging)
    fs, hpath = _hadoop_fs(spark, path)
    _, hstage = _hadoop_fs(spark, staging)
    _, hold = _hadoop_fs(spark, f"{path}.__old-{tag}")
    if not fs.rename(hpath, hold):
        raise OSError(f"table {name} could not be set aside; its new content is at {staging}")
    if not fs.rename(hstage, hpath):
        restored = fs.rename(hold, hpath)
        raise OSError(f"new content of {name} could not be moved in from {staging}; "
                      + ("the old table is in place" if restored else f"the old table is at {path}.__old-{tag}"))
    fs.delete(hold, True)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """S-15: CSV with header (one file per task; no single-writer bottleneck).

    Times keep their microseconds where these are not zero; quotes inside a
    value are doubled (RFC 4180)."""
    times = (T.TimestampType, T.TimestampNTZType)
    text = df.select(*[F.col(q(f.name)).cast("string").alias(f.name) if isinstance(f.dataType, times)
                       else F.col(q(f.name)) for f in df.schema.fields])
    text.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def table_catalog(spark: SparkSession, base: str) -> DataFrame:
    """S-16: name, size in MB, created and modified time per table.

    One row per data file from the ``binaryFile`` source with the content
    column pruned (file listing only, no data read), grouped by table folder.
    """
    fs, hbase = _hadoop_fs(spark, base)
    empty = "table string, size_mb double, created timestamp, modified timestamp"
    if not fs.exists(hbase):
        return spark.createDataFrame([], empty)
    dirs = [st.getPath().toString() for st in fs.listStatus(hbase)
            if st.isDirectory() and st.getPath().getName().endswith(".parquet")]
    if not dirs:
        return spark.createDataFrame([], empty)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(dirs)
             .select("path", "length", "modificationTime"))
    name = F.regexp_extract("path", r"([^/]+)\.parquet/.*$", 1)
    return (files.groupBy(name.alias("table"))
            .agg(F.round(F.sum("length") / (1024 * 1024), 3).alias("size_mb"),
                 F.min("modificationTime").alias("created"), F.max("modificationTime").alias("modified")))


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])
