"""Hadoop file-system helpers (work for local paths and cluster URIs alike)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = hadoop_path(spark, path)
    return bool(fs.exists(hpath))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one small file; returns its full URI."""
    fs, hpath = hadoop_path(spark, path)
    out = fs.create(hpath)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return fs.makeQualified(hpath).toString()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    import uuid
    from .session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote earlier in the same job (a merged run, say)."""
    fs, hpath = hadoop_path(spark, path)
    fs.delete(hpath, True)
