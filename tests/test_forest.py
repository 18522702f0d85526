"""Forests over the cells of binned rows."""

import numpy as np
import pytest
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparkprep.ml import core as M
from sparkprep.ml import forest
from sparkprep.ml.metrics import classification_metrics, regression_metrics


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, y double").withColumn("features", array_to_vector("v"))


def value(metrics, name):
    return {r[0]: r[1] for r in metrics.collect()}[name]


def test_regression_is_as_good_as_sparks_forest(spark):
    rng = np.random.default_rng(1)
    x = np.c_[rng.integers(0, 40, 3000), rng.normal(size=3000)]
    y = x[:, 0] ** 2 / 50 + 6 * np.sin(x[:, 1]) + rng.normal(size=3000)
    df = table(spark, x, y)
    est = MR.RandomForestRegressor(numTrees=30, maxDepth=8, seed=42, labelCol="y", featuresCol="features")
    mine = forest.fit_forest(est, df.where("id < 2500"), "y", plain_rows=0)
    assert isinstance(mine, forest.ForestModel) and len(mine.trees) == 30
    test = df.where("id >= 2500")
    a, b = (value(regression_metrics(m.transform(test), "y", "prediction"), "R2") for m in (mine, est.fit(df.where("id < 2500"))))
    assert a > 0.9 and a > b - 0.03


def test_classification_has_shares_and_is_as_good_as_sparks_forest(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int) + (x[:, 2] > 0.8)
    df = table(spark, x, y)
    est = MC.RandomForestClassifier(numTrees=30, maxDepth=8, seed=42, labelCol="y", featuresCol="features")
    mine = forest.fit_forest(est, df.where("id < 2500"), "y", 3, plain_rows=0)
    test = df.where("id >= 2500")
    got = mine.transform(test)
    shares = np.array([r[0] for r in got.select(vector_to_array("probability")).collect()])
    assert np.allclose(shares.sum(axis=1), 1) and (shares.argmax(axis=1) == [r[0] for r in got.select("prediction").collect()]).all()
    a, b = (value(classification_metrics(m.transform(test).withColumnRenamed("y", "label"), "label", "prediction"), "Accuracy")
            for m in (mine, est.fit(df.where("id < 2500"))))
    assert a > 0.85 and a > b - 0.04
    again = forest.ForestModel.load(spark, str(tmp_path / "f"), mine.save(spark, str(tmp_path / "f")))
    assert got.select("id", "prediction").exceptAll(again.transform(test).select("id", "prediction")).count() == 0


@pytest.mark.parametrize("classes", [False, True])
def test_bags_draw_every_row_by_poisson(spark, classes):
    """Over 400 trees each row is drawn once on average with variance one, whatever cell it shares; labels are summed with it."""
    rows = spark.createDataFrame([([float(i % 3), 1.0], float(i % 2), 50.0 if classes else 1.0) for i in range(6 if classes else 300)],
                                 "x array<double>, y double, w double").repartition(3)
    got = forest.bags(rows, 400, 2 + classes, classes, 7).collect()
    n = np.zeros((400, 3)), np.zeros((400, 3))
    for r in got:
        cells, drawn, total = (np.frombuffer(r[c]) for c in ("cells", "drawn", "total"))
        for c, k, s in zip(cells.reshape(-1, 2 + classes), drawn, total):
            n[0][r["tree"], int(c[0])] += k
            n[1][r["tree"], int(c[0])] += s
    assert np.allclose(n[0].mean(axis=0), 100, atol=2.5) and (n[0].var(axis=0) > 70).all() and (n[0].var(axis=0) < 135).all()
    assert np.allclose(n[1].mean(axis=0), 50, atol=2)


def test_many_rows_train_over_cells_and_many_cells_over_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = table(spark, rng.normal(size=(600, 2)), rng.normal(size=600))
    est = MR.RandomForestRegressor(numTrees=3, maxDepth=4, seed=1, labelCol="y", featuresCol="features")
    assert isinstance(forest.fit_forest(est, df, "y", plain_rows=100), forest.ForestModel)
    assert not isinstance(forest.fit_forest(est, df, "y", plain_rows=100, most_cells=10), forest.ForestModel)
    monkeypatch.setattr(forest.fit_forest, "__defaults__", (0, "features", 100, forest.MOST_CELLS))
    got = M.train(df.select("id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), "y"), ["a", "b"], "y", "forest", "regression", "id")
    assert isinstance(got.model, forest.ForestModel)
