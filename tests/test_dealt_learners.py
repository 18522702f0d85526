"""Learners whose rows are dealt to all tasks (F14, F16): the preparation, its Gram sums, and the RBF machine on packed blocks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkprep.ml import core as M
from sparkprep.ml import custom
from sparkprep.ml.gram import gram


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, y double")
    return df.withColumn("features", array_to_vector("x"))


def test_one_partition_is_dealt_and_only_needed_columns_are_held(spark):
    df = frame(spark, np.random.default_rng(1).normal(size=(300, 2)), range(300))
    df = df.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "y").coalesce(1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        p = M.prepare(df, ["a", "b"], "y", "regression", "id", deal=True)
        assert p.train.rdd.getNumPartitions() > 1
        assert p.train.columns == ["id", "y", "features"]
        assert p.train.count() + p.test.count() == 300 and "split" not in p.test.columns
        p.release()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_gram_meets_parts_of_far_apart_means(spark):
    x = np.random.default_rng(2).normal(size=(200, 3))
    x[100:] += 1e7
    df = frame(spark, x, range(200)).select("x")
    n, mean, s = gram(df.where("x[0] < 1e6").coalesce(1).union(df.where("x[0] > 1e6").coalesce(1)).union(df.limit(0)))
    assert n == 200 and np.allclose(mean, x.mean(axis=0), rtol=1e-12)
    assert np.allclose(s, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-9)
    assert gram(df.limit(0))[0] == 0


@pytest.mark.parametrize("classes", [2, 3])
def test_packed_rbf_machine_meets_spark(spark, tmp_path, monkeypatch, classes):
    x = np.random.default_rng(3).uniform(-2, 2, (900, 2))
    y = np.searchsorted([2.2] if classes == 2 else [1.5, 3.5], (x ** 2).sum(axis=1))
    df = frame(spark, x, y).repartition(3)
    plain = custom.fit_rbf_svm(df, "y", classes)
    monkeypatch.setattr(custom, "PLAIN_ROWS", 100)
    packed = custom.fit_rbf_svm(df, "y", classes)
    assert plain.weights is None and packed.svm is None and packed.error == plain.error
    got, want = ({r["id"]: r["prediction"] for r in m.transform(df).select("id", "prediction").collect()} for m in (packed, plain))
    assert np.mean([got[i] == want[i] for i in got]) > 0.97
    assert np.mean([got[i] == y[i] for i in got]) > 0.95
    again = custom.NystroemModel.load(spark, *(str(tmp_path / "m"), packed.save(spark, str(tmp_path / "m"))))
    assert {r["id"]: r["prediction"] for r in again.transform(df).select("id", "prediction").collect()} == got
