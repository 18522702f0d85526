"""Ranked lexical search (12): range-maximum sparse tables over posting lists, and best-first document intervals.

* **Shards.**  Documents go to shards of at most ``SHARD`` documents by their
  partitions, each in the order of its ids.  A shard holds the posting list
  (document, occurrences) of every term that some query may ask for: a bitmap
  of a fixed size, filled from all query terms, says which.  Terms are compared
  as strings.  Shards are written to the shared scratch folder.
* **Statistics** (documents, terms, document frequencies) are Spark aggregates
  over all shards; they give each (item, term) its weight.
* **Search.**  In a shard each posting list gets a sparse table: for each power
  of two, the place of the largest impact of so many postings from each place
  on.  For an item, the range maxima of its terms over an interval of documents
  add up to a bound.  The intervals of the highest bounds are split next: at
  the document where the term that gives most to the bound has its maximum.
  That document is scored exactly, both rests get their bounds, and intervals
  that can't hold a better document than the k-th best so far are dropped.
  Of equal scores the smaller place wins, so long runs of ties end early.
* k documents of each (item, shard) go on, and a window ranks them.

Items are packed into groups of about ``GROUP_TERMS`` terms; each (shard,
group) pair is a bounded piece of work of one task.  Texts beyond a piece are
counted in segments that end between terms.

Defined cases: a null or empty text has no terms; an item without terms has no
result; rows that share an item id, null included, are one item with the terms
of all; each document row counts and ranks by itself, a null id after all
others; equal scores go by ascending id; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._fs import scratch_dir
from .kernels import ALNUM, LOWER, as_bytes, pieces
from .registry import read, register
from .word_codes import codes, joined, word_array, word_spans

#: Documents and postings that end a shard, terms of a group of items, and bits of the term bitmap as a power of two.
SHARD, POSTINGS, GROUP_TERMS, FILTER_BITS = 1 << 14, 2_000_000, 200_000, 20
PIECE_BYTES = 1 << 20
#: Intervals that are split together.
SPLITS = 64


def segments(texts: list, limit: int = PIECE_BYTES):
    """(bytes, owners) of pieces of the texts; a longer text is cut behind bytes that belong to no term."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            cut = at + limit
            while cut < len(t) and ALNUM[LOWER[t[cut - 1]]]:
                cut += 1
            parts.append(t[at:cut]), owner.append(i)
            at = cut
        parts.append(t[at:]), owner.append(i)
    for lo, hi in pieces(parts, limit):
        yield parts[lo:hi], np.array(owner[lo:hi])


def _terms(parts: list) -> tuple[np.ndarray, list, np.ndarray]:
    """(code of each term occurrence, distinct terms by code, occurrences before each part and in all)."""
    raw, begins = joined(parts)
    raw = LOWER[raw]
    s, e = word_spans(raw, ALNUM)
    code, distinct = codes(word_array(raw, s, e))
    return code, distinct.to_pylist(), np.searchsorted(s, begins)


def _counted(*keys: np.ndarray, weights: np.ndarray | None = None) -> tuple:
    """The distinct key rows, last key first in order, and the sum of their weights (or their number)."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    n = np.ones(len(order), dtype=np.int64) if weights is None else weights[order]
    return *(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, n): how often each term stands in the rows of an item."""
    kind = items.schema[id_col].dataType.simpleString()

    def count(batches):
        for b in batches:
            for parts, owner in segments(as_bytes(b.column(1))):
                code, distinct, first = _terms(parts)
                own, code, n = _counted(np.repeat(owner, np.diff(first)), code)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array([distinct[c].decode() for c in code], pa.string()), pa.array(n)],
                                                 ["item", "term", "n"])

    plain = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(count, f"item {kind}, term string, n bigint").groupBy("item", "term").agg(F.sum("n").alias("n"))


def term_filter(asked: DataFrame) -> np.ndarray:
    """2**FILTER_BITS flags by term checksum, summed up in Spark as bitmaps of 4 096 bytes."""
    place = F.shiftrightunsigned(F.crc32(F.col("term").cast("binary")), 32 - FILTER_BITS)
    maps = (asked.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("int").alias("k"))
            .agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("m")).collect())
    out = np.zeros((max(1, (1 << FILTER_BITS) // 32768), 32768), dtype=bool)
    for r in maps:
        out[r.k] = np.unpackbits(np.frombuffer(r.m, dtype=np.uint8), bitorder="little")
    return out.ravel()


class _Shard:
    """A shard while it grows."""

    def __init__(self):
        self.ids, self.sizes, self.vocabulary, self.rows, self.postings = [], [], {}, [], 0

    def add(self, ids: list, texts: list, wanted: np.ndarray) -> None:
        base = len(self.ids)
        sizes = np.zeros(len(ids), dtype=np.int64)
        for parts, owner in segments(texts):
            code, distinct, first = _terms(parts)
            np.add.at(sizes, owner, np.diff(first))
            number = np.full(len(distinct), -1, dtype=np.int64)
            for c, t in enumerate(distinct):
                if wanted[zlib.crc32(t) >> 32 - FILTER_BITS]:
                    number[c] = self.vocabulary.setdefault(t, len(self.vocabulary))
            term, doc = number[code], np.repeat(owner + base, np.diff(first))
            some = term >= 0
            self.rows.append(_counted(doc[some], term[some]))
            self.postings += len(self.rows[-1][0])
        self.ids += ids
        self.sizes.append(sizes)

    def row(self) -> dict:
        """Documents by id; postings by term (as strings are ordered), then by document."""
        doc, term, n = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        doc, term, n = _counted(place[doc], rank[term], weights=n)
        sizes = np.concatenate(self.sizes)[order]
        lists = np.bincount(term, minlength=len(names))
        return {"ids": [self.ids[i] for i in order], "terms": [t.decode() for t in names], "df": lists.tolist(), "n_docs": int((sizes > 0).sum()),
                "n_terms": int(sizes.sum()), "sizes": sizes.tobytes(), "doc": doc.astype(np.int32).tobytes(), "tf": n.astype(np.int64).tobytes()}


def build_shards(docs: DataFrame, wanted: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The posting lists of all documents for the terms that ``wanted`` lets through, written to ``path``; one row a shard."""
    spark = docs.sparkSession
    shared, id_type = spark.sparkContext.broadcast(np.packbits(wanted)), docs.schema[id_col].dataType.simpleString()

    def build(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        part, k, now = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            ids, texts, at = b.column(0).to_pylist(), as_bytes(b.column(1)), 0
            while at < len(ids):
                end = min(len(ids), at + 1024, at + shard - len(now.ids))
                now.add(ids[at:end], texts[at:end], flags)
                at = end
                if len(now.ids) >= shard or now.postings >= POSTINGS:
                    yield batch(part, k, now.row(), b.column(0).type)
                    k, now = k + 1, _Shard()
        if now.ids:
            yield batch(part, k, now.row(), b.column(0).type)

    def batch(part, k, r, kind):
        types = {"ids": pa.list_(kind), "terms": pa.list_(pa.string()), "df": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_terms": pa.int64(),
                 "sizes": pa.binary(), "doc": pa.binary(), "tf": pa.binary()}
        cols = [pa.array([part], pa.int32()), pa.array([k], pa.int32())] + [pa.array([r[c]], t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays(cols, ["part", "k", *types])

    fields = f"part int, k int, ids array<{id_type}>, terms array<string>, df array<bigint>, n_docs bigint, n_terms bigint, sizes binary, doc binary, tf binary"
    made = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(build, fields)
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


class Lists:
    """Posting lists of one shard with the impact of each posting, and a sparse table for each list.

    ``first[i]:first[i+1]`` is list i; ``table[j][at]`` is the place of the largest impact among 2**j postings from ``at`` on
    (the first of several), for the lists that are so long."""

    def __init__(self, doc: np.ndarray, impact: np.ndarray, lengths: np.ndarray, n_docs: int):
        by_length = np.argsort(-lengths, kind="stable")
        start = np.concatenate([[0], np.cumsum(lengths)])
        take = np.concatenate([np.arange(start[i], start[i + 1]) for i in by_length]) if len(lengths) else np.empty(0, np.int64)
        self.doc, self.impact, self.n_docs = doc[take], impact[take], n_docs
        size = lengths[by_length]
        ends = np.cumsum(size)
        self.begin, self.end = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        self.begin[by_length], self.end[by_length] = ends - size, ends
        row = np.empty(len(lengths), np.int64)
        row[by_length] = np.arange(len(lengths))
        self.row, self.key = row, np.repeat(np.arange(len(size)), size) * n_docs + self.doc
        self.table = [np.arange(len(take), dtype=np.int32)]
        step = 1
        while len(size) and size[0] >= 2 * step:
            upto = int(ends[np.flatnonzero(size >= 2 * step)[-1]])
            a = self.table[-1][:upto]
            b = np.concatenate([a[step:], a[len(a) - min(step, len(a)):]])
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a))
            step *= 2

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact of places a..b-1, each within one list; anything where the range is empty."""
        out = np.minimum(a, max(0, len(self.doc) - 1))
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        for j in np.unique(level):
            at = np.nonzero((level == j) & (b > a))
            x, y = self.table[j][a[at]], self.table[j][b[at] - (1 << j)]
            out[at] = np.where(self.impact[y] > self.impact[x], y, x)
        return out

    def top(self, lists: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest weighted sums of impacts above 0, equal ones by document."""
        docs = scores = np.empty(0, np.int64)
        row = self.row[lists] * self.n_docs

        def bounded(l, r, a, b):
            """Open intervals with their bounds and the documents to split them at; those that can't matter are left out."""
            place = self.largest(a, b)
            part = np.where(b > a, self.impact[place] * weight, 0)
            bound = part.sum(axis=1)
            split = self.doc[place[np.arange(len(l)), part.argmax(axis=1)]]
            return _matter([l, r, a, b, bound, split], docs, scores, k)

        heap = bounded(np.array([0]), np.array([self.n_docs]), self.begin[lists][None], self.end[lists][None])
        while len(heap[0]):
            order = np.lexsort((heap[0], -heap[4]))
            (l, r, a, b, _, d), rest = ([x[o] for x in heap] for o in (order[:SPLITS], order[SPLITS:]))
            at = np.searchsorted(self.key, row + d[:, None])
            has = at < b
            has[has] = np.broadcast_to(self.key[at[has]] == (row + d[:, None])[has], (int(has.sum()),))
            score = np.where(has, self.impact[np.minimum(at, len(self.key) - 1)] * weight, 0).sum(axis=1)
            docs, scores = np.concatenate([docs, d]), np.concatenate([scores, score])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            new = bounded(np.concatenate([l, d + 1]), np.concatenate([d, r]), np.concatenate([a, at + has]), np.concatenate([at, b]))
            rest = _matter(rest, docs, scores, k)
            heap = [np.concatenate([x, y]) for x, y in zip(rest, new)]
        return docs[scores > 0], scores[scores > 0]


def _matter(heap: list, docs: np.ndarray, scores: np.ndarray, k: int) -> list:
    """The intervals that can still hold one of the k best: a higher score, or an equal one at an earlier document."""
    l, r, bound = heap[0], heap[1], heap[4]
    ok = (bound > 0) & (l < r)
    if len(docs) == k:
        ok &= (bound > scores[-1]) | (bound == scores[-1]) & (l < docs[-1])
    return [x[ok] for x in heap]


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 12 m) with m = 75 + (25 size n_docs) div n_terms, for each posting."""
    if 25 * int(size.max(initial=0)) * n_docs < 1 << 63:
        m = 75 + 25 * size * n_docs // max(n_terms, 1)
    else:
        m = np.array([75 + 25 * int(s) * n_docs // n_terms for s in size], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _searcher(k: int, n_docs: int, n_terms: int):
    def search(shards: pa.Table, groups: pa.Table) -> pa.Table:
        got = []
        asked = [r for g in groups.column("asked").to_pylist() for r in g]
        for s in shards.to_pylist():
            number = {t: i for i, t in enumerate(s["terms"])}
            doc, tf = np.frombuffer(s["doc"], np.int32).astype(np.int64), np.frombuffer(s["tf"], np.int64)
            impact = impacts(tf, np.frombuffer(s["sizes"], np.int64)[doc], n_docs, n_terms)
            lengths = np.array(s["df"], dtype=np.int64)
            used = np.zeros(len(lengths), dtype=bool)
            items: dict = {}
            for r in asked:
                t = number.get(r["term"])
                if t is not None:
                    used[t] = True
                    items.setdefault(r["item"], []).append((t, r["weight"]))
            keep = np.repeat(used, lengths)
            lists = Lists(doc[keep], impact[keep], lengths[used], len(s["ids"]))
            new = np.cumsum(used) - 1
            for item, terms in items.items():
                t, w = np.array(terms, dtype=np.int64).T
                d, score = lists.top(new[t], w, k)
                got += [(item, s["ids"][i], x) for i, x in zip(d.tolist(), score.tolist())]
        item = groups.schema.field("asked").type.value_type.field("item").type
        kinds = (item, shards.schema.field("ids").type.value_type, pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 3, kinds)], ["item_id", "doc_id", "score"])
    return search


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", shard: int = SHARD, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    store = scratch_dir(spark, "lexical")
    counted = item_terms(items, item_col, item_text)
    counted.write.parquet(f"{store}/items")
    counted = spark.read.schema(counted.schema).parquet(f"{store}/items")
    shards = build_shards(docs, term_filter(counted), f"{store}/shards", id_col, text_col, shard)

    n, n_docs, n_terms = shards.agg(F.count("*"), F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    idf = F.floor(1000.0 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = counted.join(df, "term").select("item", "term", (idf * F.col("n")).alias("weight")).filter("weight > 0")
    groups = -(-counted.count() // group_terms) or 1
    of = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
    packed = weighted.groupBy(of.alias("turn")).agg(F.collect_list(F.struct("item", "term", "weight")).alias("asked"))

    # A shard and a group meet under a lane: about one shard, seldom some more.
    lanes = max(1, n)
    left = (shards.withColumn("lane", F.pmod(F.xxhash64("part", "k"), F.lit(lanes)).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = packed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    fields = f"item_id {items.schema[item_col].dataType.simpleString()}, doc_id {docs.schema[id_col].dataType.simpleString()}, score bigint"
    found = left.groupBy("lane", "turn").cogroup(right.groupBy("lane", "turn")).applyInArrow(_searcher(k, n_docs, n_terms), fields)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS c FROM q GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM p, s GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, r, sum(c * wt * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM qt JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
      FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


@register("op12_lexical_search", SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
