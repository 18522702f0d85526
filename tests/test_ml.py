"""Properties of the learners without a SQL twin."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkprep.ml import core as M
from sparkprep.ml import custom, knn
from sparkprep.ml.smote import smote_nc


@pytest.fixture(scope="module")
def linear_data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = 2.0 + x @ np.array([1.5, -3.0, 0.5]) + rng.normal(scale=0.01, size=800)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(800))
    return spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array("a", "b", "c")))


def test_sgd_objective_recovers_coefficients(linear_data):
    model = custom.fit_sgd_regressor(linear_data, "y")
    assert np.allclose(model.coef, [1.5, -3.0, 0.5], atol=0.01)
    assert abs(model.intercept - 2.0) < 0.01


def test_linear_svr_fits(linear_data):
    model = custom.fit_linear_svr(linear_data, "y")
    pred = model.transform(linear_data).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert pred < 0.5


def test_linear_svr_on_a_large_target_at_the_defaults(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 3))
    y = 50_000 + x @ np.array([300.0, -200.0, 50.0]) + rng.normal(0, 20, 1500)
    rows = [(x[i].tolist(), float(y[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "v array<double>, y double").withColumn("features", array_to_vector("v"))
    one, eight = (custom.fit_linear_svr(df.repartition(k), "y") for k in (1, 8))
    assert np.allclose(one.coef, eight.coef, atol=1e-6) and abs(one.intercept - eight.intercept) < 1e-6
    pred = x @ one.coef + one.intercept
    assert 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9


def test_tree_takes_a_feature_of_many_levels(spark):
    rows = [(i, f"level{i % 50}", float(i % 7), "ab"[i % 50 > 20]) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, s string, x double, y string")
    res = M.train(df, ["s", "x"], "y", "tree", "classification", "id", scaler=None)
    assert res.predictions.count() > 0


def test_knn_exact_against_bruteforce(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(300, 4))
    pdf = pd.DataFrame({"id": range(300), "label": (pts[:, 0] > 0).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("i", F.col("id"))
    vec = spark.createDataFrame([(i, pts[i].tolist()) for i in range(300)], "id long, v array<double>")
    data = df.join(vec, "id").withColumn("features", array_to_vector("v"))
    tr, te = data.where("id < 240"), data.where("id >= 240")
    for rows, group in ((300, 300), (60, 7), (2, 25)):  # one block, some, and enough for two levels of merging
        index = knn.KNNIndex(tr, "id", "features", block_rows=rows)
        got = index.query(te, "id", k=5, group_rows=group).select("qid", "tid", "rank").collect()
        got = {(r.qid, r.rank): r.tid for r in got}
        for q in range(240, 300):
            d = np.sqrt(((pts[:240] - pts[q]) ** 2).sum(axis=1))
            order = np.lexsort((np.arange(240), d))[:5]
            for rank, t in enumerate(order, start=1):
                assert got[(q, rank)] == t


def test_knn_exact_with_a_hot_cluster_in_many_blocks(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(300, 3))
    pts[:100] = pts[0] + rng.normal(scale=1e-3, size=(100, 3))  # a third of the rows are near-copies
    pts[100:110] = pts[0]                                         # exact ties, broken by id
    vec = spark.createDataFrame([(i, pts[i].tolist()) for i in range(300)], "id long, features array<double>")
    tr, te = vec.where("id % 5 <> 0"), vec.where("id % 5 = 0")
    train_ids = np.array([i for i in range(300) if i % 5])
    for block_rows in (9, 54, 1000):
        index = knn.KNNIndex(tr, "id", "features", block_rows=block_rows)
        got = {(r.qid, r.rank): r.tid for r in index.query(te, "id", k=4).collect()}
        for q in range(0, 300, 5):
            d = np.sqrt(((pts[train_ids] - pts[q]) ** 2).sum(axis=1))
            order = train_ids[np.lexsort((train_ids, d))[:4]]
            assert [got[(q, r)] for r in range(1, 5)] == list(order)


def test_knn_self_excluded_with_categorical_codes(spark):
    """Mismatching codes cost a fixed distance; ids are strings, copies tie, far-off points make the products cancel."""
    rng = np.random.default_rng(9)
    pts = np.c_[rng.normal(size=(120, 2)) + 1e6, rng.integers(0, 3, (120, 2))]
    pts[60:80] = pts[0]
    df = spark.createDataFrame([(f"r{i:03d}", pts[i].tolist()) for i in range(120)], "id string, v array<double>")
    index = knn.KNNIndex(df, "id", "v", block_rows=25, categorical=2, mismatch=0.7)
    nn = index.query(df, "id", k=6, features="v", exclude_self=True, group_rows=50)
    assert not any("Join" in line for line in nn._jdf.queryExecution().executedPlan().toString().splitlines())
    got = {(r.qid, r["rank"]): (r.tid, r.dist) for r in nn.collect()}
    assert len(got) == 720
    for i in range(120):
        d = np.sqrt(((pts[:, :2] - pts[i, :2]) ** 2).sum(axis=1) + 0.7 ** 2 * (pts[:, 2:] != pts[i, 2:]).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(120), d)) if j != i][:6]
        assert [got[(f"r{i:03d}", r + 1)] for r in range(6)] == [(f"r{j:03d}", d[j]) for j in order]


def test_adaboost_beats_majority(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y})
    df = spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array("a", "b")))
    model = custom.fit_adaboost(df, "label", 2, rounds=20)
    acc = model.transform(df).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > max(y.mean(), 1 - y.mean()) + 0.1


def test_split_is_deterministic_and_sized(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    a = M.with_split(o, "o_orderkey", 0.2).where("split = 'test'").select("o_orderkey")
    b = M.with_split(o.repartition(7), "o_orderkey", 0.2).where("split = 'test'").select("o_orderkey")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    share = a.count() / o.count()
    assert 0.17 < share < 0.23


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(3)
    n0, n1 = 120, 20
    pdf = pd.DataFrame({"id": range(n0 + n1), "x": np.r_[rng.normal(0, 1, n0), rng.normal(5, 1, n1)],
                        "cat": ["a"] * 60 + ["b"] * 60 + ["c"] * 10 + ["d"] * 10, "y": [0] * n0 + [1] * n1})
    out = smote_nc(spark.createDataFrame(pdf), "y", "id", k=5)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: n0, 1: n0}
    syn = out.where("synthetic").toPandas()
    lo, hi = pdf[pdf.y == 1].x.min(), pdf[pdf.y == 1].x.max()
    assert syn.x.between(lo, hi).all()
    assert set(syn.cat) <= {"c", "d"}


def test_train_pipeline_classification(spark):
    from sparkprep.suite.ml import X_CLF, orders_classification
    res = M.train(orders_classification(spark, "/root/testdata/sf0.001"), X_CLF, "o_orderstatus", "nb",
                  "classification", "o_orderkey")
    metrics = {r.metric: r.value for r in res.metrics.collect()}
    assert set(metrics) == {"Accuracy", "Precision", "Recall", "F1 Score"}
    assert all(0 <= v <= 1 for v in metrics.values())
