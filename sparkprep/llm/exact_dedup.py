"""Exact dedup (8): distributed MSD radix partitioning of normalised texts.

Documents are split by successive bytes, most significant first: by length and
the first bytes, then by wider and wider runs of the bytes that follow.  A
group that holds one document, or whose bytes have ended, is finished; only
documents of groups that still hold two or more are carried on.  Groups are
compared on the bytes themselves, so equality needs no digest (the digest in
the result only reports the text).

Each round counts (group, bytes) with a partial aggregate, so a hot group
sends one row per task, and joins the counts back; that join is left to the
skew-join split of adaptive execution.  The tables of a round are written to
the shared scratch folder, which also fixes the group numbers.

Defined cases: null texts are equal to empty ones; a null id sorts after every
other; rows that repeat both id and text are one document and share its fate,
though group_size counts them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._fs import scratch_dir
from .kernels import as_bytes
from .registry import read, register

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes of the first split, and the factor by which each next one is wider.
FIRST, WIDER = 64, 32


def normalised(docs: DataFrame, id_col: str, text_col: str, rest: bool) -> DataFrame:
    """(id, n_cp of the original, n_bytes, head, sha[, rest]) of each text without blanks."""
    names = ["id", "n_cp", "n_bytes", "head", "sha"] + ["rest"] * rest

    def strip(batches):
        for b in batches:
            raw = as_bytes(b.column(1))
            norm = [t.translate(None, BLANKS) for t in raw]
            cols = [b.column(0), pa.array([len(t) if t.isascii() else len(t.decode("utf-8")) for t in raw], pa.int64()),
                    pa.array([len(t) for t in norm], pa.int64()), pa.array([t[:FIRST] for t in norm], pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())]
            if rest:
                cols.append(pa.array([t[FIRST:] for t in norm], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(strip, f"id {kind}, n_cp bigint, n_bytes bigint, head binary, sha string" + ", rest binary" * rest)


def _groups(df: DataFrame, *by) -> DataFrame:
    """The groups of two or more, numbered, with the document each would keep."""
    best = F.min(F.struct((-F.col("n_cp")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("i")))
    return (df.groupBy(*by).agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1")
            .withColumn("g2", F.monotonically_increasing_id()))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, sha, keep_id, group_size.

    keep_id is the document of the class with the most characters, then the smallest id."""
    spark, store = docs.sparkSession, scratch_dir(docs.sparkSession, "radix")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store}/{name}")

    def finished(df: DataFrame) -> DataFrame:
        return df.select("id", "sha", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.i")).alias("keep_id"),
                         F.coalesce("n", F.lit(1)).alias("group_size"))

    rows = keep(normalised(docs, id_col, text_col, rest=False), "rows")
    groups = keep(_groups(rows, "n_bytes", "head"), "groups0")
    more = groups.filter(F.col("n_bytes") > FIRST)
    marked = rows.join(groups.hint("merge"), ["n_bytes", "head"], "left")
    done = [finished(marked.filter(F.col("n").isNull() | (F.col("n_bytes") <= FIRST)))]
    if more.isEmpty():
        return done[0]

    # The bytes after the head, fetched once and for the documents of open groups only.
    active = keep(normalised(docs, id_col, text_col, rest=True)
                  .join(more.select("n_bytes", "head", F.col("g2").alias("g")).hint("merge"), ["n_bytes", "head"])
                  .select("id", "n_cp", "sha", "g", "rest"), "active0")
    level, width = 0, FIRST * WIDER
    while True:
        split = active.withColumn("piece", F.expr(f"substring(rest, 1, {width})"))
        level += 1
        groups = keep(_groups(split, "g", "piece"), f"groups{level}")
        ended = F.length("rest") <= width
        step = split.join(groups.hint("merge"), ["g", "piece"], "left")
        done.append(finished(step.filter(F.col("n").isNull() | ended)))
        if groups.filter(F.length("piece") == width).isEmpty():
            break
        active = keep(step.filter(F.col("n").isNotNull() & ~ended)
                      .select("id", "n_cp", "sha", F.col("g2").alias("g"), F.expr(f"substring(rest, {width} + 1)").alias("rest")),
                      f"active{level}")
        width *= WIDER
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    kept = classes(docs, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "sha").distinct()

    def digest(batches):
        for b in batches:
            sha = [hashlib.sha256(t.translate(None, BLANKS)).hexdigest() for t in as_bytes(b.column(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string())], [*b.schema.names, "__sha"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.mapInArrow(digest, f"{fields}, __sha string").alias("d")
    k = kept.alias("k")
    same = (F.col("d.__sha") == F.col("k.sha")) & F.col(f"d.{id_col}").eqNullSafe(F.col("k.id"))
    return marked.join(k, same, "left_semi").select(*docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
g AS (SELECT x, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256
FROM t JOIN g USING (x)
"""


@register("op8_exact_dedup", SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classes(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
