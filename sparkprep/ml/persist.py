"""Saving and loading of fitted models (M-25): preparation, estimator and what scoring needs, in one folder.

Spark ML parts are saved by Spark; the parameters of the library's own models
are rows (name, shape, values) of a Parquet table beside them.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def write_arrays(spark: SparkSession, path: str, arrays: dict) -> None:
    rows = [(k, list(np.shape(v)), [float(x) for x in np.ravel(v)]) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> dict:
    return {r["name"]: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def _classes() -> dict:
    from . import custom, forest, knn, perceptron, trees
    return {c.__name__: c for c in (custom.LinearModel, custom.NystroemModel, custom.AdaBoostModel, knn.KNNModel, trees.DeepTreeModel,
                                   forest.ForestModel, perceptron.PerceptronModel)}


def save(result, path: str) -> str:
    """Write a ``TrainResult`` to ``path``."""
    path = path.rstrip("/")
    spark = result.predictions.sparkSession
    result.prep.write().overwrite().save(f"{path}/prep")
    own = type(result.model).__name__ if type(result.model).__name__ in _classes() else None
    about = {"class": own, "kind": result.kind, "task": result.task, "key": result.key}
    if own:
        about["own"] = result.model.save(spark, f"{path}/model")
    else:
        PipelineModel(stages=[result.model]).write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def load(spark: SparkSession, path: str) -> tuple:
    """(preparation, model, description) of a saved result."""
    path = path.rstrip("/")
    about = json.loads(spark.read.parquet(f"{path}/about").select(F.col("about")).first()[0])
    prep = PipelineModel.load(f"{path}/prep")
    if about["class"]:
        model = _classes()[about["class"]].load(spark, f"{path}/model", about["own"])
    else:
        model = PipelineModel.load(f"{path}/model")
    return prep, model, about
