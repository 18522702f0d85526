"""License scans (3): diagonal voting over rolling word k-grams.

Every document sends all its rolling word 2-gram hashes to a Spark join with
the template positions (a table of fixed size, broadcast).  A match at
document word p and template word t votes for the diagonal p - t; votes are
collected per (document, template, diagonal) as a bit set.  Neighbouring
diagonals of one template, which insertions and deletions cause, are merged;
clusters that can hold a place are verified on the document's words.

Base phrases are templates whose words must stand consecutively: one diagonal,
all votes, equal words.  The other templates are notices and may differ in a
fifth of their words: a place is a span of words that holds ``SHARE`` of the
notice's words in order, and of whose own words they are ``SHARE``.  ``bounds``
gives the votes and the shift of diagonals that every such span has; which
spans are places is decided on the words alone.

Defined cases: a null or empty text has no words and no labels; ids may be
null or repeat (rows are told apart by id and text; equal rows get equal
results); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import ALNUM, Words, as_bytes, pieces
from .registry import read, register

K = 2

#: Phrases whose words must stand consecutively, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices (lower-case words) and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this work has been released into the public domain": "public-domain",
}

#: Share of a notice's words, and of a place's words, that must be found in order.
SHARE = 0.8


def bounds(n: int) -> tuple[int, int]:
    """(least votes, largest shift of diagonals) of a place of a notice of n words.

    Of the n words m <= n // 5 may be missing, and (n - m) // 4 words may be added, as a place has at most 5 words for 4 found.
    A missing word breaks at most two 2-grams, an added one at most one; added words shift later diagonals up, missing ones down."""
    return n - (K - 1) - max(2 * m + (n - m) // 4 for m in range(n // 5 + 1)), n // 4


def template_table(spark: SparkSession) -> DataFrame:
    """(h, template, t, need, slack) of every position of every template."""
    rows = []
    for i, phrase in enumerate([*BASE, *NOTICES]):
        w = Words([phrase.encode()], ALNUM)
        at, h = w.grams(K)
        need, slack = (len(w) - (K - 1), 0) if i < len(BASE) else bounds(len(w))
        rows += [(int(x), i, int(t), need, slack) for t, x in zip(at, h.view(np.int64))]
    return spark.createDataFrame(rows, "h bigint, template int, t int, need int, slack int")


def grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, pos, h) of every rolling word k-gram; key tells rows of one id apart."""
    def roll(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi], ALNUM)
                at, h = w.grams(K)
                own = w.owner()[at]
                keys = np.array([xxhash.xxh64_intdigest(t) for t in texts[lo:hi]], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(own + lo)), pa.array(keys[own] if len(own) else own, pa.int64()),
                     pa.array((at - w.first[own]).astype(np.int32)), pa.array(h.view(np.int64))], ["id", "key", "pos", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(roll, f"id {kind}, key bigint, pos int, h bigint")


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, spans): merged diagonals with enough votes, as (template, first, last diagonal)."""
    spark = docs.sparkSession
    hits = grams(docs, id_col, text_col).join(F.broadcast(template_table(spark)), "h")
    by = ["id", "key", "template", "need", "slack"]
    votes = hits.groupBy(*by, (F.col("pos") - F.col("t")).alias("d")).agg(
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("votes"))
    w = Window.partitionBy("id", "key", "template").orderBy("d")
    run = votes.withColumn("new", (F.coalesce(F.col("d") - F.lag("d").over(w), F.lit(1 << 30)) > F.col("slack")).cast("int"))
    run = run.withColumn("cluster", F.sum("new").over(w))
    merged = run.groupBy(*by, "cluster").agg(F.bit_or("votes").alias("votes"), F.min("d").alias("a"), F.max("d").alias("z"))
    return (merged.filter(F.bit_count("votes") >= F.col("need"))
            .groupBy("id", "key").agg(F.collect_list(F.struct("template", "a", "z")).alias("spans")))


def _places(words: list, phrase: list) -> list:
    """(share, start, end) of the spans of words that hold enough of the phrase in order, the best first and without overlaps.

    Every span that starts with a word of the phrase is tried, by longest common subsequences of its prefixes."""
    n, known, out = len(phrase), set(phrase), []
    longest = n + n // 4
    inside = np.concatenate([[0], np.cumsum([x in known for x in words], dtype=np.int64)]).tolist()
    for i, x in enumerate(words):
        if x not in known or inside[min(i + longest, len(words))] - inside[i] < n * SHARE:
            continue
        row, best = [0] * (n + 1), (0.0, 0)
        for j in range(i, min(i + longest, len(words))):
            if words[j] in known:
                prev, row = row, [0]
                for q, y in enumerate(phrase):
                    row.append(prev[q] + 1 if words[j] == y else max(prev[q + 1], row[q]))
            best = max(best, (row[-1] / max(n, j - i + 1), i - j - 1))
        if best[0] >= SHARE:
            out.append((best[0], i, i - best[1]))
    kept = []
    for p in sorted(out, key=lambda p: (-p[0], p[2] - p[1], p[1])):
        if all(p[2] <= q[1] or q[2] <= p[1] for q in kept):
            kept.append(p)
    return kept


def _best(places: list) -> list:
    """Base places, and of notices that overlap only the one that matches best."""
    kept = [p for p in places if p[1]]
    for p in sorted((p for p in places if not p[1]), key=lambda p: (-p[4], p[2] - p[3], p)):
        if all(p[3] <= q[2] or q[3] <= p[2] for q in kept if not q[1]):
            kept.append(p)
    return sorted(kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places) of every row: places are verified (label, base, first word, end, share)."""
    texts, labels = [p.encode().split() for p in [*BASE, *NOTICES]], [*BASE.values(), *NOTICES.values()]
    n_base = len(BASE)
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                                ("share", pa.float64())]))

    def verify(batches):
        for b in batches:
            raw, spans = as_bytes(b.column(1)), b.column(2).to_pylist()
            n_words, places = [], []
            for lo, hi in pieces(raw):
                w = Words(raw[lo:hi], ALNUM)
                n_words += w.count.tolist()
                for i in range(lo, hi):
                    out, begin, stop = [], int(w.first[i - lo]), int(w.first[i - lo + 1])
                    for s in spans[i] or ():
                        t, phrase = s["template"], texts[s["template"]]
                        slack = 0 if t < n_base else bounds(len(phrase))[1]
                        a, z = max(begin, begin + s["a"] - slack), min(stop, begin + s["z"] + len(phrase) + slack)
                        words = [w.word(j) for j in range(a, z)]
                        if t < n_base:
                            if words == phrase:
                                out.append((labels[t], True, a - begin, z - begin, 1.0))
                            continue
                        out += [(labels[t], False, a + i - begin, a + j - begin, share) for share, i, j in _places(words, phrase)]
                    places.append([dict(zip(("label", "base", "start", "end", "share"), o)) for o in _best(out)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(places, place)],
                                             ["id", "n_words", "places"])

    def keyed(batches):
        for b in batches:
            keys = [xxhash.xxh64_intdigest(t) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(keys, dtype=np.uint64).view(np.int64))], ["id", "text", "key"])

    d = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
         .mapInArrow(keyed, f"id {kind}, text string, key bigint").alias("d"))
    c = candidates(docs, id_col, text_col).hint("merge").alias("c")
    both = d.join(c, F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.key") == F.col("c.key")), "left")
    return both.select("d.id", "d.text", "c.spans").mapInArrow(
        verify, f"id {kind}, n_words bigint, places array<struct<label:string,base:boolean,start:bigint,end:bigint,share:double>>")


@register("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return got.withColumn("b", base).select(
        F.col("id").alias("doc_id"), "n_words", F.size("b").cast("bigint").alias("n_base"),
        F.array_min(F.transform("b", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("b", lambda p: p["start"])).alias("last_word"),
        names(F.col("b")).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
