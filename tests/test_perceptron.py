"""The perceptron's gradient, its search, and the model against Spark's."""

import numpy as np
from pyspark.ml import classification as MC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparkprep.ml import core as M
from sparkprep.ml import perceptron as P


def test_gradient_and_search():
    rng = np.random.default_rng(1)
    sizes, x, y = (3, 5, 4), rng.normal(size=(50, 3)), rng.integers(0, 4, 50)
    u = rng.normal(size=3 * 5 + 5 + 5 * 4 + 4)
    got = P.loss_and_gradient(u, sizes, x, y)
    for i in range(len(u)):
        e = np.zeros(len(u))
        e[i] = 1e-6
        slope = (P.loss_and_gradient(u + e, sizes, x, y)[0] - P.loss_and_gradient(u - e, sizes, x, y)[0]) / 2e-6
        assert abs(slope - got[1 + i]) < 1e-5
    a = rng.normal(size=(30, 30))
    a, b = a @ a.T + np.eye(30), rng.normal(size=30)
    found = P.minimise(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(30), 500, 1e-12)
    assert np.allclose(found, np.linalg.solve(a, b), atol=1e-4)


def test_many_rows_give_a_model_as_good_as_sparks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 0] > 1.2)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, v array<double>, label double")
    df = df.withColumn("features", array_to_vector("v")).repartition(3).persist()
    est = MC.MultilayerPerceptronClassifier(layers=[2, 20, 3], maxIter=60, seed=42)
    mine = P.fit_perceptron(est, df, "label", plain_rows=0)
    assert isinstance(mine, P.PerceptronModel) and not isinstance(P.fit_perceptron(est, df.limit(40), "label"), P.PerceptronModel)
    got = mine.transform(df)
    right = [m.transform(df).where("prediction = label").count() / 1500 for m in (mine, est.fit(df))]
    assert right[0] > 0.9 and right[0] > right[1] - 0.03
    p = np.array([r[0] for r in got.select(vector_to_array("probability")).collect()])
    assert np.allclose(p.sum(axis=1), 1)
    again = P.PerceptronModel.load(spark, str(tmp_path / "p"), mine.save(spark, str(tmp_path / "p")))
    assert got.select("id", "prediction").exceptAll(again.transform(df).select("id", "prediction")).count() == 0
    monkeypatch.setattr(P.fit_perceptron, "__defaults__", ("features", 100))
    flat = df.select("id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("label").cast("string").alias("c"))
    assert isinstance(M.train(flat, ["a", "b"], "c", "mlp", "classification", "id").model, P.PerceptronModel)
