"""The bit-sliced index against sorted integer products."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from sparkprep.llm import bit_sliced_search as B

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 300), st.integers(0, 8), st.sampled_from([1, 3, 50, 200, 5000, 2 ** 28]),
       st.sampled_from([1, 3, 7, 40]), st.integers(1, 7), st.booleans())
def test_top_rows_of_a_block(seed, n, dims, big, keep, k, copies):
    r = np.random.default_rng(seed)
    x = r.integers(-big, big + 1, (n, dims))
    if copies:
        x[r.integers(0, n, n // 2)] = x[0]
    block, order = B.Slices(x, keep), r.permutation(n)
    for q in (x[-1], r.integers(-big, big + 1, dims)):
        out = r.choice(n, min(n, 3), replace=False).tolist()
        rows, score = block.top(q, out, order, k)
        every = x @ q
        want = sorted(set(range(n)) - set(out), key=lambda i: (-every[i], order[i]))[:k]
        assert rows.tolist() == want and score.tolist() == [int(every[i]) for i in want]


def test_quantised_sums_add_up():
    """The slices hold the quantised scores themselves, raised by the same amount in every row."""
    r = np.random.default_rng(1)
    x, q = r.integers(-150, 150, (200, 5)), np.array([7, -3, 0, 120, -128])
    block = B.Slices(x, 4)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(int) << i for i, s in enumerate(block.sums(q)))
    assert len(set(total - (x - x.min(axis=0) >> block.shift) @ q)) == 1


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(E.oracle_sql()["op11_topk_search"]).df()
    got = E.queries()["op11_topk_search"](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None))


ROWS = [(0, [0.5, 0.5]), (50, [0.5, -0.5]), (50, [0.5, -0.5]), (100, None), (150, [float("nan"), 1.0]), (200, [None, 1.0]), (250, [float("inf"), 0.0]),
        (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5]), (4, []), (None, [0.5, 0.5]), (5, [-0.001, 0.0]), (300, [])]


@pytest.mark.parametrize("block,group", [(1, 1), (3, 2), (100, 100)])
def test_odd_rows(spark, block, group):
    """Nulls, non-finite and missing components, ties, repeated rows and extra columns with the names of results, however they are dealt."""
    table = spark.createDataFrame([(i, v, "x", 7) for i, v in ROWS], "vec_id long, embedding array<double>, score string, rank int")
    index = B.Index.build(table, block=block)
    got = sorted(tuple(r) for r in index.search(table.filter("vec_id % 50 = 0"), k=4, group=group).collect())
    fine = [(i, np.floor(np.array((v + [0.0] * 2)[:2]) * 256).astype(int)) for i, v in ROWS
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in fine:
        if i is not None and i % 50 == 0:
            best = sorted(((-int(q @ x), j is None, j) for j, x in fine if j != i), key=lambda t: (t[0], t[1], t[2] or 0))[:4]
            want += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(best)]
    assert got == sorted(want, key=lambda t: t[:2]) or sorted(map(str, got)) == sorted(map(str, want))


def test_empty_and_too_long(spark):
    schema = "vec_id string, embedding array<float>"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], schema)
    assert B.Index.build(none).search(some).count() == 0 and B.Index.build(some).search(none).count() == 0
    assert [tuple(r) for r in B.Index.build(some).search(some.filter("vec_id = 'a'")).collect()] == [("a", 1, "b", 256 * 512)]
    with pytest.raises(Exception, match="64-bit"):
        B.Index.build(spark.createDataFrame([("a", [1e30])], schema))
