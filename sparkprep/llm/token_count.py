"""Token counts (9): overlap resynchronisation for huge documents.

A document of at most ``chunk`` characters is encoded as a whole.  A longer
one is cut into chunks that overlap, each a row of its own, so that one huge
document keeps many tasks busy.  Both neighbours of a seam encode the overlap
with offsets; the seam is spliced at a boundary that

* is a token boundary of both encodings, and
* is proven stable: the character before it is not white space and the one
  after it is an ASCII blank.  The pre-tokeniser's alternatives never run across such a
  place, none looks behind, and the only look-ahead sits in runs of white
  space, so nothing on one side can change the tokens of the other.

Seams without such a common boundary are encoded again with an overlap four
times as wide, until the chunk reaches the ends of the document.

Whole documents go through the same proof at every blank: a piece between two
stable boundaries has the same tokens wherever it stands, so each worker keeps
a bounded table of piece lengths and asks the library for unknown pieces only.
Strings of added tokens hold no white space, so no cut runs through one.  A
tokenizer to which the proof does not apply gets every text whole.

Defined cases: a null text is empty and has no tokens; ids are passed through,
null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._fs import scratch_dir
from .registry import read, register

CHUNK, OVERLAP = 1 << 16, 256

#: Pieces whose lengths a worker keeps (about 100 MB).
KEPT = 600_000

_tokenizers: dict = {}


def _path(name: str) -> str:
    """A tokenizer file by path, or by the name of an installed public one."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Counter:
    """Token counts of whole texts, through a table of pieces between stable boundaries."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(_path(name))
        with open(_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        #: The proof needs the byte-level pattern, no normaliser, no blank put in front and plain added tokens.
        self.provable = bool(
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
            and not pre.get("add_prefix_space") and spec.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added))
        self.length: dict = {}

    def encode(self, texts: list) -> list:
        return self.library.encode_batch(texts, add_special_tokens=False)

    def counts(self, texts: list) -> list:
        if not self.provable:
            return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [_pieces(t) for t in texts]
        if len(self.length) > KEPT:
            self.length.clear()
        new = list({p for ps in cut for p in ps} - self.length.keys())
        for k in range(0, len(new), 4096):
            part = new[k:k + 4096]
            self.length.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False))))
        return [sum(map(self.length.__getitem__, ps)) for ps in cut]


#: A blank after a character that isn't white space, as the library's pattern (Unicode) sees it.
_EDGE = re.compile(r"(?<=\S)(?= )")


def _pieces(text: str) -> list:
    """The text cut at every blank that follows a character that isn't white space."""
    parts = text.split(" ")
    if "" not in parts and not any(p[-1].isspace() for p in parts):  # the last character of each stands before a blank
        return [parts[0], *[" " + p for p in parts[1:]]]
    cuts = [0, *[m.start() for m in _EDGE.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def counter(name: str) -> Counter:
    if name not in _tokenizers:
        _tokenizers[name] = Counter(name)
    return _tokenizers[name]


def stable(text: str, at: int) -> bool:
    """Whether the cut before text[at] is proven stable."""
    return 0 < at < len(text) and text[at] in " \t\n\r\x0b\x0c" and not text[at - 1].isspace()


def zone_boundaries(text: str, offsets: list, lo: int, hi: int) -> dict:
    """Position -> tokens before it, for the stable token boundaries of text[lo:hi]."""
    out = {}
    for i, (a, b) in enumerate(offsets):
        if a >= hi:
            break
        if a >= lo and stable(text, a) and (i == 0 or offsets[i - 1][1] <= a):
            out[a] = i
    return out


def _encode_chunks(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Each chunk's token count and its stable boundaries in both overlaps, as positions in the document.

    rows: doc, no, at (start in the document), body, left, right (characters of overlap at either end)."""
    def encode(batches):
        c = counter(tokenizer)
        for b in batches:
            out = []
            for at, body, left, right in zip(*[b.column(x).to_pylist() for x in ("at", "body", "left", "right")]):
                e = c.encode([body])[0]
                head = zone_boundaries(body, e.offsets, 0, left) if left else {}
                tail = zone_boundaries(body, e.offsets, len(body) - right, len(body)) if right else {}
                out.append((len(e.ids), {at + p: n for p, n in head.items()}, {at + p: n for p, n in tail.items()}))
            kind = pa.map_(pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("no"), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([list(o[1].items()) for o in out], kind), pa.array([list(o[2].items()) for o in out], kind)],
                ["doc", "no", "n", "head", "tail"])

    return rows.mapInArrow(encode, "doc bigint, no int, n bigint, head map<bigint,bigint>, tail map<bigint,bigint>")


def chunk_counts(huge: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, n_tokens) of the documents of ``huge`` (doc, text), each cut into overlapping chunks."""
    spark, store = huge.sparkSession, scratch_dir(huge.sparkSession, "chunks")
    huge.write.parquet(f"{store}/huge")
    huge = spark.read.schema(huge.schema).parquet(f"{store}/huge").withColumn("size", F.char_length("text"))
    todo, done, rounds = huge, [], 0
    while True:
        # Chunk no covers [no * chunk - overlap, (no + 1) * chunk + overlap) of the document.
        last = ((F.col("size") - 1) / chunk).cast("int")
        rows = todo.withColumn("no", F.explode(F.sequence(F.lit(0), last))).withColumn("last", last)
        left = F.when(F.col("no") > 0, overlap).otherwise(0)
        begin = F.col("no").cast("long") * chunk - left
        end = F.when(F.col("no") == F.col("last"), F.col("size")).otherwise(
            F.least(F.col("size"), (F.col("no").cast("long") + 1) * chunk + overlap))
        right = F.when(F.col("no") < F.col("last"), end - (F.col("no").cast("long") + 1) * chunk + overlap).otherwise(0)
        rows = rows.select("doc", "no", begin.alias("at"), F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int")).alias("body"),
                           F.when(F.col("no") > 0, 2 * overlap).otherwise(0).alias("left"), right.alias("right"))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        got = _encode_chunks(rows.repartition(parts, "doc", "no"), tokenizer)
        got.write.parquet(f"{store}/round{rounds}")
        got = spark.read.schema(got.schema).parquet(f"{store}/round{rounds}")
        # Splice: the first common boundary of a chunk's tail and its successor's head.
        w = Window.partitionBy("doc").orderBy("no")
        seam = F.array_min(F.array_intersect(F.map_keys("tail"), F.map_keys(F.lead("head").over(w))))
        spliced = got.withColumn("cut", seam).withColumn("is_last", F.lead("no").over(w).isNull())
        spliced = spliced.withColumn("from", F.lag("cut").over(w))
        stop = F.when(F.col("is_last"), F.col("n")).otherwise(F.try_element_at("tail", F.col("cut")))
        start = F.when(F.col("no") == 0, 0).otherwise(F.try_element_at("head", F.col("from")))
        totals = spliced.groupBy("doc").agg(F.sum(stop - start).alias("n_tokens"),
                                            F.bool_and((stop - start).isNotNull()).alias("aligned"))
        totals.write.parquet(f"{store}/totals{rounds}")
        totals = spark.read.schema(totals.schema).parquet(f"{store}/totals{rounds}")
        done.append(totals.filter("aligned").select("doc", "n_tokens"))
        failed = totals.filter("not aligned").select("doc")
        rounds += 1
        if failed.isEmpty():
            break
        todo, overlap = huge.join(failed, "doc", "left_semi"), overlap * 4
        chunk = max(chunk, 4 * overlap)  # in the end a chunk holds the whole document, which has no seam
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``."""
    spark = docs.sparkSession
    if not counter(tokenizer).provable:
        chunk = (1 << 31) - 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        c = counter(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(c.counts(texts), pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    small = plain.filter(F.char_length("text") <= chunk).mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    # Rows of huge documents get a number, fixed by writing it: ids may repeat or be null.
    store = scratch_dir(spark, "huge")
    plain.filter(F.char_length("text") > chunk).withColumn("doc", F.monotonically_increasing_id()).write.parquet(store)
    huge = spark.read.schema(f"id {kind}, text string, doc bigint").parquet(store)
    if huge.isEmpty():
        return small
    counts = chunk_counts(huge.select("doc", "text"), tokenizer, chunk, overlap)
    return small.unionByName(huge.select("doc", "id", F.octet_length("text").cast("bigint").alias("n_bytes"))
                             .join(counts, "doc").select("id", "n_bytes", "n_tokens"))


@register("op9_token_count")
def op9_token_count(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    got = token_counts(read(spark, sf_dir, "documents"), tokenizer)
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
