"""Distributed exact quantiles equal numpy's linear interpolation, hot values included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators.quantiles import exact_quantiles, quantile_frame


@pytest.mark.parametrize("accuracy,max_candidates", [(10000, 100000), (50, 20)])
def test_selection_is_exact_with_a_hot_value(spark, accuracy, max_candidates):
    rng = np.random.default_rng(11)
    x = np.r_[rng.exponential(10, 4000), np.full(2000, 3.25), rng.normal(0, 1, 20)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy=accuracy, max_candidates=max_candidates)["x"]
    assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_low_cardinality_settles_on_tied_values(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 51, 4000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.501, 0.75, 0.99, 1.0]
    for accuracy in (10000, 20):
        got = exact_quantiles(df, ["x"], probs, accuracy=accuracy, max_candidates=10)["x"]
        assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)


def test_nan_is_missing_and_single_values_work(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, None), (float("nan"), None), (3.0, None)], "x double, y double")
    got = quantile_frame(df, ["x", "y"], [0.5], max_candidates=0).first()
    assert tuple(got) == (2.0, 7.0)
    empty = quantile_frame(df.where("x > 9 AND x < 10"), ["x"], [0.5]).first()
    assert empty[0] is None


def test_quantile_frame_matches_numpy(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_extendedprice", "l_quantity"]
    got = quantile_frame(li, cols, [0.25, 0.5, 0.75]).first()
    pdf = li.select(*cols).toPandas().astype(float)
    want = [np.quantile(pdf[c], p) for c in cols for p in (0.25, 0.5, 0.75)]
    assert np.allclose(list(got), want, atol=1e-9)


def test_grouped_median_by_selection_matches_pandas_with_a_hot_key(spark):
    import pandas as pd

    from sparkprep.operators.aggregate import group_agg

    rng = np.random.default_rng(5)
    n = 3000
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n)).astype(object)
    g[:7] = None                                        # null keys are dropped
    v = rng.normal(0, 10, n).round(2)
    v[rng.random(n) < 0.1] = np.nan                    # null values are skipped
    pdf = pd.DataFrame({"g": g, "h": rng.integers(0, 2, n), "v": v})
    pdf.loc[pdf.g == "d", "v"] = np.nan                # an all-null group
    rows = [(a, int(b), None if np.isnan(c) else float(c)) for a, b, c in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    spec = {"v": ["median", "count", "mean"]}
    for keys in (["g"], ["g", "h"]):
        got = group_agg(df, keys, spec).toPandas()
        assert list(got.columns) == keys + ["v_median", "v_count", "v_mean"]
        want = pdf.dropna(subset=["g"]).groupby(keys)["v"].median().reset_index(name="want")
        m = got.merge(want, on=keys, how="outer")
        assert len(m) == len(want) == len(got)
        assert np.allclose(m["v_median"].astype(float), m["want"], equal_nan=True, atol=1e-9)


def test_grouped_quantiles_plan_has_no_window_keyed_by_the_group(spark):
    from sparkprep.operators.quantiles import grouped_quantiles

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = grouped_quantiles(li, "l_returnflag", "l_extendedprice", [0.5], ["med"])
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    # the range-bucketed row index is read back from the checkpoint: no window
    # (and so no group held by one task) is left in the plan
    assert not any("Window" in ln for ln in lines)
    assert any("ExistingRDD" in ln for ln in lines)
    # a shuffle on the group key only ever follows a partial aggregate
    for i, ln in enumerate(lines):
        if "hashpartitioning(__g0" in ln:
            assert "partial_" in lines[i + 1]


def test_group_agg_medians_only_by_selection(spark):
    from sparkprep.operators.aggregate import group_agg

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spec = {"l_extendedprice": "median", "l_quantity": ["median"]}
    keys = ["l_returnflag", "l_linestatus"]
    got = group_agg(li, keys, spec).toPandas()
    assert list(got.columns) == keys + ["l_extendedprice_median", "l_quantity_median"]
    pdf = li.select(*keys, "l_extendedprice", "l_quantity").toPandas()
    want = pdf.groupby(keys)[["l_extendedprice", "l_quantity"]].median().reset_index()
    m = got.merge(want, on=keys)
    assert len(m) == len(want) == len(got)
    for c in ("l_extendedprice", "l_quantity"):
        assert np.allclose(m[f"{c}_median"], m[c], atol=1e-9)


@pytest.mark.parametrize("limits", [{}, {"GROUP_CANDIDATES": 0}, {"BROADCAST_GROUPS": 0, "SLICE_ROWS": 100}, {"BROADCAST_GROUPS": 0, "GROUP_CANDIDATES": 0}])
def test_grouped_quantiles_of_several_columns_on_every_path(spark, monkeypatch, limits):
    """Groups of 1 to 6 000 rows, tied and all-null values; candidates gathered or numbered, brackets broadcast or joined by salt."""
    import pandas as pd

    from sparkprep.operators import quantiles as Q

    for k, v in limits.items():
        monkeypatch.setattr(Q, k, v)
    rng = np.random.default_rng(21)
    sizes = [1, 2, 3, 7, 16, 60, 700, 6000]
    g = np.repeat(np.arange(len(sizes)), sizes)
    pdf = pd.DataFrame({"g": g, "a": rng.normal(0, 5, len(g)), "b": rng.integers(0, 4, len(g)).astype(float), "c": rng.exponential(1, len(g)).round(1)})
    pdf.loc[rng.random(len(g)) < 0.1, "a"] = np.nan
    pdf.loc[pdf.g == 2, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = Q.grouped_statistics(df, "g", {c: [(p, f"{c}{i}") for i, p in enumerate(probs)] for c in "abc"}, [F.count("*").alias("rows")], accuracy=100)
    got = got.toPandas().set_index("g").sort_index()
    assert got["rows"].tolist() == sizes
    for c in "abc":
        for i, p in enumerate(probs):
            assert np.allclose(got[f"{c}{i}"].astype(float), pdf.groupby("g")[c].quantile(p), equal_nan=True, atol=1e-12)


def test_two_scans_serve_all_medians_of_a_group_by(spark, monkeypatch):
    from sparkprep.operators.aggregate import group_agg
    from sparkprep import session

    plans, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = group_agg(li, "l_returnflag", {"l_quantity": ["median", "mean"], "l_tax": "median", "l_extendedprice": ["median", "max"]})
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("FileScan parquet") for p in plans) == 2 and not any("Window" in p for p in plans)
