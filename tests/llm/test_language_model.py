"""The trigram model against counts in dictionaries, its kept form, and its use on texts it has not seen."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkprep.llm import language_model as L

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "A b", "Ünïcode ▁ 日本語 \U0001F600", "x" * 3000, "word " * 700, "the end the end the end", "a a a a b a a a", "THE End"]


def tokens(text) -> list:
    return (text or "").encode().lower().split() + [b"\n"]


class Brute:
    def __init__(self, texts: list):
        self.c1, self.c2, self.c3 = (collections.Counter() for _ in range(3))
        for t in texts:
            a = b = b" "
            for w in tokens(t):
                self.c1[w] += 1
                self.c2[b, w] += 1
                self.c3[a, b, w] += 1
                a, b = b, w
        self.n1, self.t1, self.n2, self.t2 = (collections.Counter() for _ in range(4))
        for (b, _), n in self.c2.items():
            self.n1[b] += n
            self.t1[b] += 1
        for (a, b, _), n in self.c3.items():
            self.n2[a, b] += n
            self.t2[a, b] += 1
        self.total, self.size = self.c1.total(), len(self.c1)

    def next(self, a, b, w) -> float:
        p = (self.c1[w] + 1) / (self.total + self.size + 1)
        if self.n1[b]:
            p = max(self.c2[b, w] - L.D, 0) / self.n1[b] + L.D * self.t1[b] / self.n1[b] * p
        if self.n2[a, b]:
            p = max(self.c3[a, b, w] - L.D, 0) / self.n2[a, b] + L.D * self.t2[a, b] / self.n2[a, b] * p
        return p

    def row(self, text) -> tuple:
        a = b = b" "
        score = base = 0.0
        for w in tokens(text):
            base += math.log10((self.c1[w] + 1) / (self.total + self.size + 1))
            score += math.log10(self.next(a, b, w))
            a, b = b, w
        t = tokens(text)
        return len(t), sum(self.c1[w] > 0 for w in t), self.total, base, score


def compare(got: list, brute: Brute, texts: dict):
    """Counts and base exactly; the score up to the 8 bits that its probabilities are stored in."""
    assert len(got) == len(texts)
    off = sum(r.score - brute.row(texts[r.id])[4] for r in got) / sum(r.n_tokens for r in got)
    assert abs(off) < 0.01
    for r in got:
        n, known, total, base, score = brute.row(texts[r.id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - score) < 0.05 * n


def out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_query_equals_counts_in_dictionaries_and_beats_the_base(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = E.queries()["op4_language_model"](spark, SF).withColumnRenamed("doc_id", "id").collect()
    assert {r.id: r.held_out for r in got} == {i: out(i) for i in texts}
    brute = Brute([t for i, t in texts.items() if not out(i)])
    compare(got, brute, texts)
    # over held-out texts that share no long passage with training the model still beats add-one unigrams
    fresh = [r for r in got if r.held_out and sum(brute.c3[x] > 0 for x in zip(tokens(texts[r.id]), tokens(texts[r.id])[1:], tokens(texts[r.id])[2:]))
             < 0.3 * r.n_tokens]
    n = sum(r.n_tokens for r in fresh)
    assert len(fresh) > 5 and sum(r.score for r in fresh) / n > sum(r.base_score for r in fresh) / n + 0.05


def test_probabilities_of_a_context_sum_to_one():
    brute = Brute(["a b a c a b b", "a b c"])
    for context in ((b" ", b" "), (b"a", b"b"), (b"zz", b"a"), (b"zz", b"zz")):
        assert sum(brute.next(*context, w) for w in [*brute.c1, b"unseen"]) == pytest.approx(1.0)


@pytest.mark.parametrize("shard,bucket,turn", [(2_000_000, 2_000_000, 4_000_000), (300, 50, 200), (60, 20, 4_000_000)])
def test_odd_rows_many_shards_and_hot_words(spark, monkeypatch, tmp_path, shard, bucket, turn):
    """Nulls, empty and long texts, repeated rows, extra columns with the names of results; a word with most of the tokens; a model read again."""
    monkeypatch.setattr(L, "TURN", turn)
    monkeypatch.setattr(L, "PIECE", 1000)
    rows = [(i, t, 1, "x", None) for i, t in enumerate(ODD)] + [(100 + i, f"the word the end of line {i % 4}", 1, "x", True) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score string, mark boolean").repartition(3)
    learnt = docs.where("doc_id % 5 <> 1")
    model = L.train(learnt.unionByName(spark.createDataFrame([(None, "no id", 1, "x", None)], docs.schema)), str(tmp_path / "lm"), shard=shard, bucket=bucket)
    assert (len(model.about["hot_hash"]) > 0) == (shard < 1000)
    brute = Brute([r[1] for r in rows if r[0] % 5 != 1])
    texts = {r[0]: r[1] for r in rows}
    compare(L.score(model, docs).collect(), brute, texts)
    # another session would open the same folder; other texts, rows that repeat, null ids
    again = L.Model(spark, str(tmp_path / "lm"))
    other = spark.createDataFrame([(1, "the end of the word"), (1, "the end of the word"), (None, "never seen words"), (2, None)], "doc_id long, text string")
    got = sorted((r.id or 0, r.n_tokens, round(r.score, 3)) for r in L.score(again, other, mark=F.lit(True)).collect())
    want = sorted((i or 0, brute.row(t)[0], brute.row(t)[4]) for i, t in [(1, "the end of the word")] * 2 + [(None, "never seen words"), (2, None)])
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 0.01 for g, w in zip(got, want))


def test_a_model_learnt_while_scoring_can_be_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the end of the word " * (i + 1)) for i in range(6)], "doc_id long, text string")
    model, got = L.train_and_score(docs, F.col("doc_id") < 4, str(tmp_path / "lm"))
    again = {r.id: r.score for r in L.score(model, docs).collect()}
    assert {r.id: r.score for r in got.collect()} == pytest.approx(again)


def test_nothing_to_learn_or_to_score(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    none = L.train(docs.limit(0))
    rows = {r.id: r for r in L.score(none, docs).collect()}
    assert (rows["a"].n_tokens, rows["a"].n_known, rows["a"].train_tokens, rows["a"].score, rows["b"].n_tokens) == (3, 0, 0, 0.0, 1)
    assert L.score(L.train(docs), docs.limit(0)).count() == 0


def test_packed_integers_come_back():
    r = np.random.default_rng(0)
    for a in (np.empty(0), np.zeros(3), r.integers(0, 1 << 62, 50), np.sort(r.integers(0, 1 << 40, 999)), np.array([(1 << 64) - 1, 5], dtype=np.uint64)):
        assert (L._un(L._z(a)) == a.astype(np.uint64)).all() and (L._un(L._z(np.sort(a), True)) == np.sort(a).astype(np.uint64)).all()
