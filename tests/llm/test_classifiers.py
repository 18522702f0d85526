"""The two classifiers against plain versions of their scores, and on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkprep.llm import kernels, quality, toxicity

SF = "/root/testdata/sf0.01"
TEXTS = [b"", b"plain words in a line", b"BUY now $$$ | cheap | best", "ünïcode wörter".encode(), b"one", b"the the the the " * 300]


def held(spark, query: str, label: str) -> list:
    """(label, predicted) of the held-out labelled documents."""
    got = E.queries()[query](spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    return [tuple(r) for r in got.join(labels, "doc_id").select(label, "predicted").collect()]


def recall_and_precision(rows: list, positive: int = 1) -> tuple:
    hit = sum(y == positive == p for y, p in rows)
    return hit / sum(y == positive for y, _ in rows), hit / max(1, sum(p == positive for _, p in rows))


def test_quality_votes_like_all_cosines_one_by_one(spark):
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [r[0].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()] + TEXTS
    got = model.scores(docs)
    for text, score in zip(docs, got):
        x = (quality._weights([text])[0] * model.idf) @ model.space
        if np.linalg.norm(x) <= 1e-9:
            assert score == model.share
            continue
        cosine = [float(v @ x / (np.linalg.norm(v) * np.linalg.norm(x))) for v in model.vectors]
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[:quality.K]
        vote = [max(cosine[i], 1e-3) ** quality.POWER * model.weight[i] for i in near]
        assert score == pytest.approx(sum(v * model.y[i] for v, i in zip(vote, near)) / sum(vote), abs=2e-3)


def test_quality_on_held_out_labels(spark):
    recall, precision = recall_and_precision(held(spark, "op1_quality", "quality"))
    assert recall > 0.95 and precision > 0.95


def test_toxicity_net_like_loops_over_words():
    net, r = toxicity.Net(), np.random.default_rng(0)
    net.emb[1:] = r.normal(size=net.emb[1:].shape)
    texts = [t for t in TEXTS if t][:4]
    w = kernels.Words(texts, kernels.ALNUM)
    got = net.raw(*toxicity._padded(w))
    both = toxicity._buckets(w)
    for i in range(len(texts)):
        x = [(net.emb[a] + net.emb[b]) / 2 for a, b in both[w.first[i]:w.first[i + 1]]] + [np.zeros(toxicity.DIM)] * 2
        top = []
        for k, conv, bias in zip(toxicity.WIDTHS, net.conv, net.bias):
            answers = [np.concatenate(x[j:j + k]) @ conv + bias if j + k <= len(x) else None for j in range(len(x))]
            top.append(np.maximum(np.max([a for a in answers if a is not None], axis=0), 0))
        z = np.concatenate(top) @ net.dense + net.out[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-3)


def test_toxicity_on_held_out_labels(spark):
    rows = held(spark, "op6_toxicity", "toxic")
    recall, precision = recall_and_precision(rows)
    assert recall >= 0.6 and precision >= 0.8 and len(rows) > 50


@pytest.mark.parametrize("module", [quality, toxicity])
def test_a_column_named_like_the_score_is_replaced(spark, module):
    docs = spark.createDataFrame([(1, "some text", "old")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = module.score(docs, module.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score"] and out.select(F.col("score") + 0).first()[0] >= 0
