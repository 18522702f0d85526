"""Benchmark decontamination (7): a broadcast hash set of normalised test n-grams.

``scan`` hashes every window of every document with array code, tests it
against the broadcast set and verifies each hit on the words themselves, so a
hash collision never counts.  The set is broadcast only up to a checked number
of windows; a larger benchmark is cut into blocks by window hash, each within
the bound, and the documents are scanned once per block.

Defined cases: a null or empty text has no words and no hits; a null item text
gives no windows; a null item id is written as the empty string; repeated rows
are scanned and returned one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, Members, Words, as_bytes, per_text, pieces, mix1
from .registry import read, register

#: Windows that one broadcast may hold (about 150 bytes each).
MAX_WINDOWS = 400_000


def windows(bench: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, phrase) of every window of every item; an item of fewer than n words is one window."""
    def cut(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                w = Words([text], ALNUM)
                size = min(n, len(w))
                if size:
                    out += {(item, size, w.phrase(i, size)) for i in range(len(w) - size + 1)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.binary())], ["item", "size", "phrase"])

    plain = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                         F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, "item string, size int, phrase binary").distinct()


class _Block:
    """Lookup tables of one block of windows, built once per worker from the broadcast rows."""

    def __init__(self, rows):
        self.items: dict[bytes, list] = {}
        by_size: dict[int, set] = {}
        for item, size, phrase in rows:
            self.items.setdefault(bytes(phrase), []).append(item)
            by_size.setdefault(size, set()).add(bytes(phrase))
        self.sizes = {}
        for size, phrases in by_size.items():
            w = Words(list(phrases), ALNUM)
            self.sizes[size] = Members(w.grams(size)[1])

    def find(self, w: Words):
        """(position, size, items) of every verified hit."""
        for size, members in self.sizes.items():
            at, hashes = w.grams(size)
            for i in at[members.where(hashes)]:
                got = self.items.get(w.phrase(int(i), size))
                if got:
                    yield int(i), size, got


_blocks: dict = {}


def _block_of(name: str, broadcast) -> _Block:
    """The block of this name; a worker keeps the last one it built."""
    if name not in _blocks:
        _blocks.clear()
        _blocks[name] = _Block(broadcast.value)
    return _blocks[name]


def _scan_block(docs: DataFrame, text_col: str, broadcast) -> DataFrame:
    """docs with __n_words, __spans (word ranges that windows cover) and __items appended."""
    name = uuid.uuid4().hex

    def scan(batches):
        block = _block_of(name, broadcast)
        for b in batches:
            texts = as_bytes(b.column(text_col))
            n_words, spans, items = [], [], []
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi], ALNUM)
                n_words += w.count.tolist()
                found: dict[int, tuple] = {}
                hits = sorted(block.find(w), key=lambda h: h[0])
                owner = np.searchsorted(w.first, [h[0] for h in hits], side="right") - 1 if hits else ()
                for d, (i, size, names) in zip(owner, hits):
                    s, t = found.setdefault(int(d), ([], set()))
                    i -= int(w.first[d])
                    if s and i <= s[-1][1]:
                        s[-1][1] = max(s[-1][1], i + size)
                    else:
                        s.append([i, i + size])
                    t.update(names)
                for d in range(hi - lo):
                    s, t = found.get(d, ((), ()))
                    spans.append([x for pair in s for x in pair])
                    items.append(sorted(t))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.string()))], [*b.schema.names, "__n_words", "__spans", "__items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scan, f"{fields}, __n_words bigint, __spans array<bigint>, __items array<string>")


def _union_spans(spans):
    """Merged disjoint ranges of flat [start, end, start, end ...] lists of several blocks."""
    pairs = F.array_sort(F.flatten(F.transform(spans, lambda s: F.transform(
        F.sequence(F.lit(0), (F.size(s) / 2 - 1).cast("int")), lambda i: F.struct(
            s[2 * i].alias("a"), s[2 * i + 1].alias("b"))))))
    start = F.array().cast("array<bigint>")
    return F.aggregate(pairs, start, lambda acc, p: F.when(
        (F.size(acc) > 0) & (p["a"] <= F.element_at(acc, -1)),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["b"]))))
        .otherwise(F.concat(acc, F.array(p["a"], p["b"]))))


def scan(docs: DataFrame, bench: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text",
         max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All columns of ``docs`` plus __n_words, __spans (flat list of word ranges) and __items.

    One row out per row in.  The number of windows is counted first; beyond
    ``max_windows`` the benchmark is handled in blocks of at most that many."""
    spark = docs.sparkSession
    wins = windows(bench, n, item_col, text_col)
    total = wins.count()
    blocks = -(-total // max_windows) if total else 1
    if blocks == 1:
        return _scan_block(docs, text_col, spark.sparkContext.broadcast([tuple(r) for r in wins.collect()]))
    blocks += blocks // 4 + 1  # hashing is not perfectly even
    parts = []
    for k in range(blocks):
        mine = wins.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        parts.append(_scan_block(docs, text_col, spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = (every.filter(F.size("__spans") > 0)
              .groupBy(F.xxhash64(*docs.columns).alias("__row"))
              .agg(F.collect_list("__spans").alias("s"), F.collect_set("__items").alias("i")))
    merged = merged.select("__row", _union_spans(F.col("s")).alias("__s"),
                           F.array_sort(F.array_distinct(F.flatten("i"))).alias("__i"))
    base = parts[0].drop("__spans", "__items").withColumn("__row", F.xxhash64(*docs.columns))
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return (base.join(merged, "__row", "left")
            .withColumn("__spans", F.coalesce("__s", none[0])).withColumn("__items", F.coalesce("__i", none[1]))
            .select(*docs.columns, "__n_words", "__spans", "__items"))


def hit_words(spans="__spans"):
    """Number of words inside the flat list of disjoint ranges."""
    return F.expr(f"aggregate(transform({spans}, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, mode: str = "drop", text_col: str = "text",
                  **options) -> DataFrame:
    """The documents without contamination, with the columns of ``docs``.

    ``drop`` removes documents with a hit; ``cut`` keeps them and removes the
    characters of the hit words, from the first to the last of each span."""
    got = scan(docs, bench, n, text_col=text_col, **options)
    if mode == "drop":
        return got.filter(F.size("__spans") == 0).select(*docs.columns)

    names = docs.columns

    def cut(batches):
        for b in batches:
            texts, kept = b.column(text_col).cast(pa.large_binary()).to_pylist(), []
            for t, spans in zip(texts, b.column("__spans").to_pylist()):
                if spans:
                    w, out, at = Words([t], ALNUM), [], 0
                    for a, z in zip(spans[0::2], spans[1::2]):
                        out.append(t[at:w.start[a]])
                        at = int(w.end[z - 1])
                    t = b"".join([*out, t[at:]])
                kept.append(None if t is None else t.decode("utf-8"))
            cols = [pa.array(kept, pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return got.mapInArrow(cut, docs.schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.p = bw.p),
nh AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT r, k, i FROM h)) GROUP BY r),
ni AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
       FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""


@register("op7_decontaminate", SQL)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = scan(docs, read(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit_words().alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"))
