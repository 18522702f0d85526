"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, store: str, name: str = "cc") -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the smallest vertex it is connected with.

    Every step regroups edges with partial minima and joins them back, so a hub
    sends one row per task to the aggregate and the join is split by adaptive
    execution; each round's edges are written below ``store``.  Links of a
    vertex with itself and repeated links do no harm; null ends are ignored."""
    spark = edges.sparkSession

    def keep(df: DataFrame, k: str) -> DataFrame:
        df.write.parquet(f"{store}/{name}-{k}")
        return spark.read.schema(df.schema).parquet(f"{store}/{name}-{k}")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(both: DataFrame) -> DataFrame:
        return both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    plain = edges.toDF("a", "b").filter("a is not null and b is not null")
    loops = plain.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("root"))
    e = keep(plain.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    last, k = None, 0
    while (now := state(e)) != last:
        last, k = now, k + 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a vertex is linked to the vertex's smallest neighbour.
        large = both.join(star(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.filter("a <> b").distinct(), f"{k}l")
        # Small star: the vertex and its smaller neighbours are linked to the smallest of them.
        low = star(large)
        small = (large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                               F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*"))
        e = keep(small.filter("a <> b").distinct(), f"{k}s")
    roots = e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots).unionByName(loops) \
        .groupBy("v").agg(F.min("root").alias("root"))
