"""Registry of the checked queries: each Spark query has a DuckDB twin.

Shared inputs follow FIXTURES.md §3: the driver's tables have no nulls, so the
null-handling queries inject them by a rule written identically in Spark and
in SQL.  Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def _positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``.

    DuckDB's round keeps the sign of a value that rounds to zero (-0.0) while
    Spark's round returns +0.0; adding 0.0 turns -0.0 into +0.0 and leaves
    every other value unchanged, so value hashes compare numbers, not signs."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = _positive_zero_rounds(sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- null injection (identical rule on both sides) --------------------------

def events_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        "props")


EVENTS_NULLS = """(SELECT event_id, ts, user_id,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
    props FROM events)"""


def events_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null value at both ends of the time order (ffill / bfill edges) plus inner nulls."""
    ev = table(spark, sf_dir, "events")
    edge = (F.col("ts") < F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")) | \
           (F.col("ts") > F.lit("2024-01-30 18:00:00").cast("timestamp_ntz")) | (F.col("event_id") % 7 == 0)
    return ev.select("event_id", "ts", "user_id",
                     F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
                     F.when(edge, F.lit(None)).otherwise(F.col("value")).alias("value"))


EVENTS_EDGES = """(SELECT event_id, ts, user_id,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN ts < TIMESTAMP '2024-01-01 06:00:00' OR ts > TIMESTAMP '2024-01-30 18:00:00'
              OR event_id % 7 = 0 THEN NULL ELSE value END AS value
    FROM events)"""


def customer_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(None))
                        .otherwise(F.col("c_nationkey")))


CUSTOMER_NULL_KEYS = """(SELECT c_custkey, c_name,
    CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
    c_acctbal, c_mktsegment FROM customer)"""


def r4(df: DataFrame, k: int = 4) -> DataFrame:
    """Round every double column so both engines hash the same digits."""
    from ..operators.relational import round_numeric
    return round_numeric(df, k)
