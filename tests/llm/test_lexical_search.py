"""Ranked lexical search against scores of every document."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from sparkprep.llm import lexical_search as L

SF = "/root/testdata/sf0.001"


def words(text) -> list:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs: list, items: list, k: int) -> list:
    own = [(i, collections.Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df, asked, out = collections.Counter(t for _, c in own for t in c), collections.defaultdict(collections.Counter), []
    for i, t in items:
        asked[i].update(words(t))
    for item, terms in asked.items():
        got = []
        for i, c in own:
            if c:
                m = 75 + 25 * c.total() * n_docs // n_terms
                s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in terms.items() if c[t])
                got += [(i, s)] if s > 0 else []
        got.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, n + 1, i, s) for n, (i, s) in enumerate(got[:k])]
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 12), st.integers(1, 400), st.integers(1, 25), st.integers(1, 30))
def test_best_first_intervals_find_the_top(seed, n_lists, n_docs, most, k):
    """Any posting lists, few distinct impacts (so very many ties) or many."""
    r = np.random.default_rng(seed)
    lists = [np.sort(r.choice(n_docs, r.integers(1, n_docs + 1), replace=False)) for _ in range(n_lists)]
    doc, size = np.concatenate(lists), np.array([len(x) for x in lists])
    impact, weight = r.integers(1, most + 1, len(doc)), r.integers(1, 4, n_lists)
    d, score = L.Lists(doc, impact, size, n_docs).top(np.arange(n_lists), weight, k)
    every = np.bincount(doc, weights=impact * np.repeat(weight, size), minlength=n_docs).astype(int)
    want = [i for i in sorted(range(n_docs), key=lambda i: (-every[i], i)) if every[i]][:k]
    assert d.tolist() == want and score.tolist() == every[want].tolist()


def test_few_intervals_are_opened(monkeypatch):
    """The bounds leave most documents of a shard unscored."""
    r = np.random.default_rng(5)
    lists = [np.sort(r.choice(16000, n, replace=False)) for n in (9000, 6000, 900, 40, 25)]
    doc, size = np.concatenate(lists), np.array([len(x) for x in lists])
    shard, seen = L.Lists(doc, r.integers(200, 900, len(doc)), size, 16000), []
    matter = L._matter
    monkeypatch.setattr(L, "_matter", lambda heap, *a: seen.append(len(heap[0])) or matter(heap, *a))
    shard.top(np.arange(5), np.array([10, 40, 3000, 9000, 10000]), 20)
    assert sum(seen) < 4000


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(E.oracle_sql()["op12_lexical_search"]).df()
    got = E.queries()["op12_lexical_search"](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None))


DOCS = [(5, None), (6, ""), (7, " -- "), (8, "Cat dog"), (9, "cat CAT dog bird"), (10, "cat dog"), (10, "cat dog"), (None, "cat dog"), (11, "ÄÖ cat\x00dog_x 7up"),
        (12, "bird " * 4000 + "rare"), (13, "äö ÄÖ"), (4, "cat dog"), (14, "fish"), (15, "fish fish")]
ITEMS = [(1, "cat dog dog"), (1, "bird"), (2, None), (3, "..."), (4, "ÄÖ 7UP rare"), (None, "cat"), (5, "nowhere"), (6, "fish fish cat")]


@pytest.mark.parametrize("shard,terms,piece", [(2, 2, 64), (3, 100, 1 << 20), (1000, 1000, 256)])
def test_odd_rows(spark, monkeypatch, shard, terms, piece):
    """Nulls, empty and long texts, ties, repeated ids and extra columns with the names of results; any shards, groups and segments."""
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, rank int, score string").coalesce(1)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, term int")
    for k in (2, 20):
        got = sorted((tuple(r) for r in L.search(docs, items, k, shard=shard, group_terms=terms).collect()), key=repr)
        assert got == brute(DOCS, ITEMS, k)
    text = (DOCS[9][1] + " Äöü" * 300).encode()
    parts = list(L.segments([b"", text], piece))
    assert b"".join(p for x, _ in parts for p in x) == text and {len(words(p.decode())) > 0 for x, _ in parts for p in x} <= {True, False}
    assert sum(len(words(p.decode())) for x, _ in parts for p in x) == len(words(text.decode()))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
    got = L.search(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), items.selectExpr("cast(item_id as string) as item_id", "text"))
    assert dict(got.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "string", "score": "bigint"}
