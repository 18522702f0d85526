"""Line dedup (5): levelled sorted runs of line hashes.

The memory of lines seen is a set of runs in shared storage.  A run is a table
of (line hash, documents holding it, largest document id), hash-bucketed and
sorted by hash, so it meets other runs and batches of the same bucket count
by a merge join without moving its rows again.  Each new batch is aggregated,
merge-anti-joined to the runs (what is left is new to the corpus) and written
as a run of level 0; a level that holds ``FAN`` runs is merged into one run of
the next level.  At 128 bits two lines share a hash with negligible chance.

A line key that at least ``min_docs`` documents hold loses all its lines
except in the largest document id.  Frequent keys are found in the merged
runs; the (key, document) pairs of each batch stay on disk and join them, so
no line text moves.

Defined cases: a null or empty text is one empty line; a null id sorts below
every other; rows that repeat an id count as documents of their own for the
threshold, and each of those that carry the largest id keeps the line; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._fs import remove, scratch_dir
from .kernels import as_bytes
from .registry import read, register

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Runs of one level that are merged into one of the next.
FAN = 4


def _key(line: bytes, min_chars: int):
    """128-bit hash of a line's key, or None if the key is too short to count."""
    k = line.strip(BLANKS)
    if len(k) < min_chars or not k.isascii() and len(k.decode("utf-8")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(k.lower())


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches_n: int) -> DataFrame:
    """Distinct (key, id) of each row, and the batch its document belongs to."""
    def cut(batches):
        for b in batches:
            at, keys = [], []
            for i, t in enumerate(as_bytes(b.column(1))):
                own = {_key(x, min_chars) for x in t.split(b"\n")}
                own.discard(None)
                keys += own
                at += [i] * len(own)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), b.column(0).take(take), b.column(2).take(take)], ["key", "id", "batch"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.pmod(F.xxhash64(id_col), F.lit(batches_n)).cast("int").alias("batch"))
    return plain.mapInArrow(cut, f"key binary, id {kind}, batch int")


class LineRuns:
    """Levelled runs of line hashes; each is a bucketed, sorted table in the shared scratch folder.

    Columns: key, n (documents of its batches), last (largest id), fresh (no earlier run held the key)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.store, self.tag = scratch_dir(spark, "lines"), uuid.uuid4().hex[:12]
        self.levels: list[list[str]] = []
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{self.tag}_{self.made}"
        self.made += 1
        run.write.option("path", f"{self.store}/{name}").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merge(self, names: list[str]) -> DataFrame:
        """One row per key of the named runs.

        The runs are read as plain files: a grouped union of bucketed tables skips the exchange it needs."""
        every = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.store}/{n}" for n in names])
        return every.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))

    def add(self, pairs: DataFrame) -> None:
        """Add a batch of (key, id): merge-anti-join the runs, write the batch's own run, compact full levels.

        Keys without a match are new to the corpus; matched ones only add to the counts."""
        batch = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        fresh = F.lit(True)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.filter("fresh").select("key", F.lit(True).alias(f"seen{i}")).hint("merge"), "key", "left")
            fresh = fresh & F.col(f"seen{i}").isNull()
        self._write(batch.select("key", "n", "last", fresh.alias("fresh")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merge(old), level + 1)
            for n in old:
                self.spark.sql(f"DROP TABLE {n}")
                remove(self.spark, f"{self.store}/{n}")
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """(key, last) of the keys that at least ``min_docs`` documents hold."""
        names = [n for level in self.levels for n in level]
        merged = self.spark.table(names[0]) if len(names) == 1 else self._merge(names)
        return merged.filter(F.col("n") >= min_docs).select("key", "last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, batches: int = 4, fan: int = FAN) -> DataFrame:
    """(id, n_lines, n_dropped, kept text) of every row of ``docs``.

    The corpus enters the runs in ``batches`` batches, as a growing corpus would."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fan=fan)
    path = f"{runs.store}/pairs"
    line_keys(docs, id_col, text_col, min_chars, batches).write.partitionBy("batch").parquet(path)
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = spark.read.schema(f"key binary, id {kind}, batch int").parquet(path)
    for k in range(batches):
        runs.add(pairs.filter(F.col("batch") == k).select("key", "id"))
    lose = (pairs.join(runs.frequent(min_docs), "key").filter(~F.col("id").eqNullSafe(F.col("last")))
            .groupBy("id").agg(F.collect_set("key").alias("keys")))

    def drop(batches_in):
        for b in batches_in:
            n_lines, n_dropped, kept = [], [], []
            for t, keys in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    lines = [x for x in lines if _key(x, min_chars) not in gone]
                    t = b"\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    d, k = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).alias("d"), lose.alias("k")
    both = d.join(k, F.col("d.id").eqNullSafe(F.col("k.id")), "left").select("d.id", "d.text", "k.keys")
    return both.mapInArrow(drop, f"id {kind}, n_lines bigint, n_dropped bigint, kept string")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x
            FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM d))),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (f.k IS NOT NULL AND l.doc_id <> f.last) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op5_line_dedup", SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
