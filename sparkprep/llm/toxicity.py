"""Toxicity (6): a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings.  Filters of widths 1, 2 and 3 run
over the words of a text, each filter keeps its largest answer, and a dense
layer turns these into a probability.  The first embedding dimension starts
from the smoothed log odds of a word's bucket in the training sample; all
weights are then trained with Adam.  The probability is calibrated by
language: texts are told apart by function words (never by a language column),
and scores are bent so that the threshold lies at 0.5.

Only the net is fitted on a bounded sample of labelled rows (``PER_CLASS`` rows
of either class of at most ``MAX_BYTES`` bytes), by one task that returns the
weights, so that no text reaches the driver.  The thresholds come from
every labelled row that is not held out: Spark scores them all and counts them
by language, label, score bin and whether the net has learnt from the row.
Learnt rows are scored too well, so the spread of scores is that of the other
rows (a fifth of the ids is never learnt from), and the size of each class in
each language is that of all rows.  Whole texts are scored.

Defined cases: a null or empty text is scored as a text without words; without
usable labels of both classes every score is the share of toxic labels (0 if
there are none); ids are passed through; repeated rows are scored one by one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM, Members, U, Words, as_bytes, mix, per_text, pieces
from .registry import read, register
from .sampling import held_out, sample_frame, sample_order, usable

PER_CLASS, MAX_BYTES = 3000, 20_000
BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 8, 64, 0.01

#: Bins of the net's answer, in which labelled rows are counted; a threshold is the lower edge of a bin.
BINS = 4096

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with was are this be by on",
    "fr": "le la les des et de un une dans que pour qui est sur par",
    "de": "der die das und nicht mit ein eine von zu den sich ist auf auch",
    "es": "el los las una y que del por con para se su al lo como",
}


def _buckets(w: Words) -> np.ndarray:
    """Two buckets of each word, from 1; bucket 0 is padding."""
    size = U((1 << BITS) - 1)
    return np.stack([w.hash % size, mix(w.hash) % size], axis=1).astype(np.int64) + 1


def _padded(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets with padding words after each text, first row of each text)."""
    pad = max(WIDTHS) - 1
    rows = np.zeros((len(w) + pad * len(w.count), 2), dtype=np.int64)
    at = np.arange(len(w)) + pad * w.owner()
    rows[at] = _buckets(w)
    return rows, w.first[:-1] + pad * np.arange(len(w.count))


def languages(w: Words) -> np.ndarray:
    """Index of the language whose function words are most frequent in each text; the number of languages if none occurs."""
    counts = []
    for words in FUNCTION_WORDS.values():
        flag = np.zeros(len(w), dtype=np.int64)
        flag[Members(Words([words.encode()], ALNUM).hash).where(w.hash)] = 1
        counts.append(per_text(flag, w.first))
    counts = np.array(counts)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(FUNCTION_WORDS))


class Net:
    """Embeddings, convolutions with max pooling, and a dense layer."""

    def __init__(self, seed: int = 6):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [r.normal(0, 0.3, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for k, c in zip(WIDTHS, self.conv):
            c[np.arange(k) * DIM, :FILTERS // 2] = 1.0 / k
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.out = np.full(1, -2.0, np.float32)

    def pooled(self, rows: np.ndarray, first: np.ndarray, arg: bool = False):
        """Largest answer of every filter in every text, and with ``arg`` the row where it stands."""
        x = (self.emb[rows[:, 0]] + self.emb[rows[:, 1]]) * np.float32(0.5)
        n, tops, args, padding = len(rows), [], [], rows[:, 0] == 0
        for k, c, b in zip(WIDTHS, self.conv, self.bias):
            answer = np.full((n, FILTERS), 0, np.float32)
            m = n - k + 1
            if m > 0:
                answer[:m] = sum(x[j:j + m] @ c[j * DIM:(j + 1) * DIM] for j in range(k)) + b
                answer[padding] = 0  # a window that begins in the padding would reach into the next text
            top = np.maximum(np.maximum.reduceat(answer, first, axis=0), 0) if len(first) else answer[:0]
            tops.append(top)
            if arg:
                ends = np.append(first[1:], n)
                args.append(np.array([a + answer[a:z].argmax(axis=0) for a, z in zip(first, ends)]))
        return np.concatenate(tops, axis=1), args, x

    def raw(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.pooled(rows, first)[0] @ self.dense + self.out
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _train(texts: list, y: np.ndarray, net: Net, seed: int = 6) -> None:
    seen = np.zeros((2, 1 << BITS))
    for lo, hi in pieces(texts, 1 << 20):
        w = Words(texts[lo:hi], ALNUM)
        both, own = _buckets(w), w.owner()
        pair = np.unique(np.concatenate([own * (1 << BITS) + both[:, 0], own * (1 << BITS) + both[:, 1]]))
        for label in (0, 1):
            rows = pair[y[lo + (pair >> BITS)] == label]
            seen[label] += np.bincount(rows & ((1 << BITS) - 1), minlength=1 << BITS)
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    known = seen.sum(axis=0)
    net.emb[:, 0] = np.where(known >= 3, np.clip(odds * known / (known + 4), -4, 4), 0) / 2
    net.emb[0] = 0
    params = [*net.conv, *net.bias, net.dense, net.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    second = np.full(net.emb.shape, 1e-3, np.float32)
    r = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo:lo + BATCH]
            b = Words([texts[i] for i in some], ALNUM)
            rows, first = _padded(b)
            pool, args, x = net.pooled(rows, first, arg=True)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.dense + net.out, -30, 30)))
            d = ((p - y[some]) / len(some)).astype(np.float32)
            grads, d_x = [None] * len(params), np.zeros_like(x)
            g_pool = np.outer(d, net.dense) * (pool > 0)
            for i, (k, c) in enumerate(zip(WIDTHS, net.conv)):
                g = g_pool[:, i * FILTERS:(i + 1) * FILTERS]
                gc = np.zeros_like(c)
                for f in range(FILTERS):
                    for j in range(k):
                        at = np.minimum(args[i][:, f] + j, len(x) - 1)
                        gc[j * DIM:(j + 1) * DIM, f] = g[:, f] @ x[at]
                        np.add.at(d_x, at, np.outer(g[:, f], c[j * DIM:(j + 1) * DIM, f]))
                grads[i], grads[len(WIDTHS) + i] = gc, g.sum(axis=0)
            grads[-2], grads[-1] = d @ pool, d.sum(keepdims=True)
            step += 1
            for q, g, a, c in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                q -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(c / (1 - 0.999 ** step)) + 1e-8)
            hit = np.flatnonzero(np.any(d_x != 0, axis=1))
            for col in (0, 1):
                at = rows[hit, col]
                np.add.at(second, at, d_x[hit] ** 2)
                np.add.at(net.emb, at, -0.02 * d_x[hit] / np.sqrt(second[at]))
            net.emb[0] = 0


class Toxicity:
    """A net and a threshold for each language (the last one for texts of no known language)."""

    def __init__(self, sample: list, share: float = 0.0, seed: int = 6):
        y = np.array([s[1] for s in sample], dtype=np.float64)
        self.net, self.threshold, self.share = None, np.full(len(FUNCTION_WORDS) + 1, 0.5), share
        if len(set(y)) < 2:
            return
        self.net = Net(seed)
        _train([s[0] for s in sample], y, self.net)

    def calibrate(self, counts: np.ndarray) -> None:
        """Thresholds from the number of rows by (language, label, learnt or not, bin)."""
        every, other = counts.sum(axis=(2, 3)), counts[:, :, 0].sum(axis=2)
        rows = np.where(other[:, :, None] > 0, counts[:, :, 0], counts[:, :, 1]).astype(np.float64)
        rows *= (every / np.maximum(rows.sum(axis=2), 1))[:, :, None]
        if (every.sum(axis=0) > 0).all():
            self.threshold[:] = _cut(rows.sum(axis=0))
        for k in np.flatnonzero((every > 0).all(axis=1)):
            self.threshold[k] = _cut(rows[k])

    def raw(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        scores, langs = [np.empty(0)], [np.empty(0, np.int64)]
        for lo, hi in pieces(texts, 1 << 20):
            w = Words(texts[lo:hi], ALNUM)
            scores.append(self.net.raw(*_padded(w)))
            langs.append(languages(w))
        return np.concatenate(scores), np.concatenate(langs)

    def scores(self, texts: list) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        raw, lang = self.raw(texts)
        cut = self.threshold[lang]
        return np.clip(np.where(raw < cut, 0.5 * raw / cut, 0.5 + 0.5 * (raw - cut) / (1 - cut)), 0, 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw * BINS).astype(np.int64), 0, BINS - 1)


def _cut(rows: np.ndarray) -> float:
    """The bin edge with the fewest errors, given the rows of label 0 and 1 in each bin; of several, the middle of the longest run."""
    below = np.concatenate([[0], np.cumsum(rows[1])])
    above = rows[0].sum() - np.concatenate([[0], np.cumsum(rows[0])])
    lo, hi = int(np.ceil(0.02 * BINS)), int(0.98 * BINS)
    errors = (below + above)[lo:hi + 1]
    best = np.flatnonzero(errors <= errors.min() + 1e-9 * rows.sum())
    run = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    return (lo + int(run[0] + run[-1]) // 2) / BINS


def bin_counts(docs: DataFrame, labelled: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Rows of ``labelled`` (__id, __y, __learnt) by (language, label, learnt or not, bin).

    Documents are scored before they meet their labels, so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            raw, lang = shared.value.raw(as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.astype(np.int32)), pa.array(_bin(raw).astype(np.int32))],
                                             ["__id", "lang", "bin"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).filter(F.col("__id").isNotNull())
    got = (plain.mapInArrow(run, f"__id {kind}, lang int, bin int").join(labelled, "__id")
           .groupBy("lang", "__y", "__learnt", "bin").count().toArrow())
    counts = np.zeros((len(FUNCTION_WORDS) + 1, 2, 2, BINS), dtype=np.int64)
    at = [got.column(i).to_numpy() for i in range(5)]
    counts[at[0], at[1], at[2], at[3]] = at[4]
    return counts


def trained(sample: DataFrame | None, share: float) -> Toxicity:
    """The net of a bounded sample (__id, __text, __y), fitted in one task that returns the weights only."""
    def train(batches):
        rows = [r for b in batches for r in zip(as_bytes(b.column(0)), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Toxicity(rows, share))], pa.binary())], ["model"])

    if sample is None:
        return Toxicity([], share)
    one = sample.repartition(1).sortWithinPartitions(*sample_order()).select("__text", "__y")
    return pickle.loads(one.mapInArrow(train, "model binary").first()[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Toxicity:
    own = usable(labels, label)
    share = own.agg(F.avg("__y")).first()[0]
    kept_back = held_out("__id", 5, 1)  # never learnt from: crc32 mod 5 is 0 for held-out rows and 1 for these
    sample, ids = sample_frame(docs, own.filter(~kept_back), per_class, max_bytes)
    model = trained(sample, share or 0.0)
    if model.net is None:
        return model
    flagged = own.join(F.broadcast(ids.select("__id").withColumn("__in", F.lit(1))), "__id", "left").select(
        "__id", "__y", F.coalesce("__in", F.lit(0)).alias("__learnt"))
    model.calibrate(bin_counts(docs, flagged, model))
    return model


def score(docs: DataFrame, model: Toxicity, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column, in place of one of that name; the model is of a fixed size and is broadcast."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.scores(as_bytes(b.column(text_col)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with the columns of ``docs``; all of them if the labels are of one class only."""
    model = fit(docs, labels)
    if model.net is None:
        return docs
    return score(docs, model, name="__toxic").filter(F.col("__toxic") < 0.5).select(*docs.columns)


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
