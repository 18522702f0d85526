"""Quality classifier (1): nearest-neighbour voting over latent-semantic vectors.

Terms are the byte trigrams of a text whose letters and digits are replaced by
their kind, hashed into ``TERMS`` columns: what junk, shouting, tables and
prose differ in; and its words, hashed into ``WORDS`` columns beside them: what
texts of one layout differ in.  Term weights are log frequencies times inverse document
frequency; a truncated singular value decomposition of the labelled sample
gives the latent space.  The labelled vectors are broadcast (their number is
bounded), and every document is compared with all of them by blocked matrix
products; the ``K`` nearest vote, weighted by a power of the cosine.

The sample holds at most ``PER_CLASS`` labelled rows of either class of at
most ``MAX_BYTES`` bytes; classes are weighted back to their shares in the
labels.  Whole texts are scored.

Defined cases: a null or empty text has a zero vector and gets the share of
label 1; without labels of both classes every score is that share (1 if there
are no labels); ids are passed through; repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, U, Words, as_bytes, pieces
from .registry import read, register
from .sampling import held_out, labelled_texts

PER_CLASS, MAX_BYTES = 2000, 50_000
TERMS, WORDS, RANK, K, POWER, BLOCK = 4096, 4096, 48, 25, 8, 512

#: Weight of word columns against shape columns, so that topics and languages do not outweigh the layout.
WORD_WEIGHT = 0.25

#: Kind of each byte: lower-case and non-ASCII letters, capitals, digits, then ASCII signs as they are.
KIND = np.arange(256, dtype=np.int64)
KIND[97:123] = KIND[128:] = 97
KIND[65:91] = 65
KIND[48:58] = 48


def term_counts(texts: list) -> np.ndarray:
    """Trigram counts, one row of TERMS columns per text."""
    raw = np.frombuffer(b"\n\n".join(texts) + b"\n\n", dtype=np.uint8)
    code = KIND[raw]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    own = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(own)) + 2 * own
    term = (code[at] * 1_000_003 + code[at + 1] * 8_191 + code[at + 2] * 127) * 2_654_435_761 % (1 << 32) >> 20
    return np.bincount(own * TERMS + term, minlength=len(texts) * TERMS).reshape(len(texts), TERMS)


def word_counts(texts: list) -> np.ndarray:
    """Word counts, one row of WORDS columns per text."""
    w = Words(texts, ALNUM)
    term = (w.hash % U(WORDS)).astype(np.int64)
    return np.bincount(w.owner() * WORDS + term, minlength=len(texts) * WORDS).reshape(len(texts), WORDS)


def _log_shares(counts: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.log1p(1000 * share).astype(np.float32)


def _weights(texts: list) -> np.ndarray:
    return np.concatenate([_log_shares(term_counts(texts)), np.float32(WORD_WEIGHT) * _log_shares(word_counts(texts))], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Neighbours:
    """Latent space, labelled vectors and their weights."""

    def __init__(self, sample: list, share: float):
        self.share, self.vectors = share, None
        y = np.array([s[1] for s in sample], dtype=np.float64)
        if len(set(y)) < 2:
            return
        texts, parts = [s[0].encode("utf-8") for s in sample], []
        for lo, hi in pieces(texts):
            parts += [_weights(texts[a:min(hi, a + BLOCK)]) for a in range(lo, hi, BLOCK)]
        x = np.concatenate(parts)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        x *= self.idf
        r, rank = np.random.default_rng(1), min(RANK, len(x), TERMS + WORDS)
        basis = np.linalg.qr(x @ r.normal(size=(TERMS + WORDS, rank + 16)).astype(np.float32))[0]
        for _ in range(3):  # power iterations of the randomised decomposition
            basis = np.linalg.qr(x @ (x.T @ basis))[0]
        self.space = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T.copy()
        self.vectors = _unit(x @ self.space)
        self.y = y
        self.weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))

    def scores(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.vectors is None:
            return out
        for lo, hi in pieces(texts, 1 << 20):
            for a in range(lo, hi, BLOCK):
                z = min(hi, a + BLOCK)
                q = (_weights(texts[a:z]) * self.idf) @ self.space
                filled = np.linalg.norm(q, axis=1) > 1e-9
                cosine = _unit(q) @ self.vectors.T
                k = min(K, cosine.shape[1])
                near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** POWER * self.weight[near]
                s = (vote * self.y[near]).sum(axis=1) / vote.sum(axis=1)
                out[a:z] = np.where(filled, np.clip(s, 0, 1), self.share)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Neighbours:
    share = labels.filter(F.col(label).isin(0, 1)).filter(~held_out()).agg(F.avg(label)).first()[0]
    return Neighbours(labelled_texts(docs, labels, label, per_class, max_bytes), 1.0 if share is None else float(share))


def score(docs: DataFrame, model: Neighbours, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column, in place of one of that name."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.scores(as_bytes(b.column(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
