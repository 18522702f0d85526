"""Periodic runs against a brute-force version that compares words q apart for every q."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from sparkprep.llm import periodic_runs
from sparkprep.llm.wavelet import Wavelet

SF = "/root/testdata/sf0.001"


def brute(words: list) -> list:
    names: dict = {}
    c, out = np.array([names.setdefault(w, len(names)) for w in words]), {}
    for q in range(1, len(words) // 4 + 1):
        step = np.diff(np.concatenate([[0], (c[:-q] == c[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if e - s + q >= max(6, 4 * q):
                out.setdefault((int(s), int(e) + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def row(i, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
    runs, gone = brute(w), set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs),
                                                            " ".join(x for j, x in enumerate(w) if j not in gone))]
    return i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *sha


pieces = st.recursive(st.lists(st.integers(0, 2), min_size=1, max_size=5),
                      lambda x: st.tuples(st.lists(x, min_size=1, max_size=3), st.integers(1, 7)).map(
                          lambda p: [w for part in p[0] for w in part] * p[1]), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces.map(lambda x: x[:300]), max_size=6))
def test_runs_of_nested_repeats(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    code = np.array([w for t in texts for w in t], dtype=np.int64)
    got = [[] for _ in texts]
    for t, *r in zip(*periodic_runs.runs(code, first)):
        got[t].append(tuple(map(int, r)))
    assert got == [brute(t) for t in texts]


def test_wavelet_against_sorting():
    r = np.random.default_rng(3)
    v = r.integers(0, 50, 200)
    tree = Wavelet(v)
    l = r.integers(0, 200, 500)
    e, x = np.minimum(200, l + r.integers(0, 60, 500)), r.integers(0, 140, 500)
    part = [sorted(v[a:b]) for a, b in zip(l, e)]
    assert tree.successor(l, e, x).tolist() == [next((y for y in p if y >= q), -1) for p, q in zip(part, x)]
    assert tree.predecessor(l, e, x).tolist() == [next((y for y in p[::-1] if y < q), -1) for p, q in zip(part, x)]


def test_query_equals_brute_force(spark):
    got = {r[0]: tuple(r) for r in E.queries()["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d: row(d, t) for d, t in docs} and any(r[1] for r in got.values())


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with the names of results."""
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", " x\ty\nx y x y x y\v", "ü ß " * 5 + "end", "word " * 5000,
             "p q r " * 2000 + "p", "a a a a a a b " * 6, "           "]
    rows = [(i, t, "s", None) for i, t in enumerate(texts)] + [(7, texts[7], "s", 1), (None, "z " * 9, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id long")
    got = sorted(((r.id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect()), key=repr)

    def want(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {j for s, n, q in brute(w) for j in range(s + q, s + n)}
        return i, brute(w), " ".join(x for j, x in enumerate(w) if j not in gone)

    assert got == sorted((want(i, t) for i, t, *_ in rows), key=repr)
    out = periodic_runs.collapse(docs)
    assert out.schema == docs.schema
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] is None and kept[2] == " \n" and kept[4] == texts[4] and kept[8] == "word" and kept[7] == "ü ß end"
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0 and periodic_runs.collapse(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_id_types(spark, kind):
    docs = spark.createDataFrame([(1, "a " * 8)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    assert periodic_runs.find_runs(docs, repeat=True).dtypes[0] == ("id", kind)
