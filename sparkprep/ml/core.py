"""Supervised pipelines on Spark ML (M-01 .. M-08, M-12, M-13, M-15, M-17, M-19, M-23).

The reference fits scikit-learn estimators on one pandas frame; here every
step is a Spark ML stage or a Spark job over a cached training frame:

* split: a deterministic md5 bucket of the row key (stable across re-runs and
  partitionings, unlike ``randomSplit``);
* features: numeric columns as they are, string columns label-indexed
  (classification) or one-hot encoded (regression), datetimes dropped;
* the scaler is fitted on the training part only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import feature as MF
from pyspark.ml import regression as MR
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import kind_of, q
from .scaler import KINDS, ExactScaler

SEED = 42


# ---- M-01 split --------------------------------------------------------------------

def hash_unit(key_col: str, seed: int = SEED):
    """Deterministic uniform value in [0, 1) from ``md5(key:seed)`` (60 bits)."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(q(key_col)).cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10)
    return h.cast("double") / F.lit(float(1 << 60))


def with_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``split`` = 'test' for a ``test_size`` share of keys, else 'train'."""
    return df.withColumn("split", F.when(hash_unit(key, seed) < F.lit(test_size), "test").otherwise("train"))


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED):
    """M-01: (train, test) frames."""
    s = with_split(df, key, test_size, seed)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


# ---- M-02 / M-03 features and scaler ------------------------------------------------------

def feature_stages(df: DataFrame, x_cols, task: str, out: str = "features_raw"):
    """M-02: stages turning ``x_cols`` into one vector column ``out``.

    Regression one-hot encodes string columns (all levels kept), classification
    uses their sorted label index; datetime columns are dropped."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    stages, inputs = [], []
    for c in x_cols:
        k = kind_of(fields[c])
        if k == "datetime":
            continue
        if k == "string":
            idx = f"{c}__idx"
            stages.append(MF.StringIndexer(inputCol=c, outputCol=idx, stringOrderType="alphabetAsc",
                                           handleInvalid="error"))
            if task == "regression":
                stages.append(MF.OneHotEncoder(inputCol=idx, outputCol=f"{c}__ohe", dropLast=False))
                inputs.append(f"{c}__ohe")
            else:
                inputs.append(idx)
        else:
            inputs.append(c)
    stages.append(MF.VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    return stages


def scaler_stage(kind: str | None, inp: str = "features_raw", out: str = "features"):
    """M-03: standard / minmax / robust scaler stage (fitted on train only)."""
    if kind in (None, "none"):
        return MF.VectorAssembler(inputCols=[inp], outputCol=out)
    name = {"Standard Scaler": "standard", "Min Max Scaler": "minmax", "Robust Scaler": "robust"}.get(kind, kind)
    if name not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}")
    return ExactScaler(inputCol=inp, outputCol=out, kind=name)


def prepare_stages(df: DataFrame, x_cols, y: str, task: str, scaler: str | None):
    stages = feature_stages(df, x_cols, task)
    stages.append(scaler_stage(scaler))
    if task == "classification":
        stages.append(MF.StringIndexer(inputCol=y, outputCol="label", stringOrderType="alphabetAsc",
                                       handleInvalid="error"))
    return stages


# ---- estimators (M-04 .. M-19) -------------------------------------------------------

REGRESSORS = ("linear", "xgboost", "tree", "forest", "gbt", "knn", "svr", "sgd")
CLASSIFIERS = ("logistic", "tree", "forest", "knn", "nb", "svm", "gbt", "adaboost", "mlp")


def spark_estimator(kind: str, task: str, n_features: int | None = None, n_classes: int | None = None, depth: int | None = None):
    """The Spark ML estimator for a model name, or None when it is a custom one; ``depth`` is that of a forest's trees (at most 30)."""
    if task == "regression":
        return {
            "linear": lambda: MR.LinearRegression(solver="normal", regParam=0.0),
            "xgboost": lambda: MR.GBTRegressor(maxDepth=6, stepSize=0.3, maxIter=100, seed=SEED),
            "forest": lambda: MR.RandomForestRegressor(numTrees=100, maxDepth=depth or 12, seed=SEED),
            "gbt": lambda: MR.GBTRegressor(maxDepth=3, stepSize=0.1, maxIter=100, seed=SEED),
        }.get(kind, lambda: None)()
    multi = (n_classes or 2) > 2
    if kind == "logistic":
        lr = MC.LogisticRegression(maxIter=100)
        return MC.OneVsRest(classifier=lr) if multi else lr
    if kind == "forest":
        return MC.RandomForestClassifier(numTrees=100, maxDepth=depth or 12, seed=SEED)
    if kind == "nb":
        return MC.NaiveBayes(modelType="gaussian")
    if kind == "gbt":
        g = MC.GBTClassifier(maxDepth=3, stepSize=0.1, maxIter=100, seed=SEED)
        return MC.OneVsRest(classifier=g) if multi else g
    if kind == "mlp":
        return MC.MultilayerPerceptronClassifier(layers=[n_features, 100, n_classes], maxIter=200, seed=SEED)
    return None


def room_for_levels(est, df: DataFrame, features: str = "features") -> None:
    """Tree learners need at least as many bins as the widest categorical feature has levels."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    most = max([len(a.get("vals", ())) for a in attrs.get("nominal", ())], default=0)
    inner = est.getClassifier() if isinstance(est, MC.OneVsRest) else est
    if inner.hasParam("maxBins") and most > inner.getOrDefault("maxBins"):
        inner.set(inner.getParam("maxBins"), most)


@dataclass
class TrainResult:
    kind: str
    task: str
    prep: PipelineModel
    model: object
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    key: str = ""
    extra: dict = field(default_factory=dict)


@dataclass
class Prepared:
    """One split of a table with its fitted preparation; several learners can share it."""
    task: str
    key: str
    label: str
    prep: PipelineModel
    train: DataFrame
    test: DataFrame
    n_classes: int | None
    held: list

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def _vector_size(df: DataFrame, col: str = "features") -> int:
    return df.select(F.size(vector_to_array(F.col(col)))).first()[0]


#: Learners whose results hang on the rows only: their table is dealt evenly to tasks, however few files or row groups it is read from.
DEALT = ("linear", "svr", "sgd", "svm")


def prepare(df: DataFrame, x_cols, y: str, task: str, key: str, test_size: float = 0.2, scaler: str | None = "standard", order_by=None,
            deal: bool = False) -> Prepared:
    """Split and preparation, from one scan of ``df``: its columns are held until ``release``; ``deal`` spreads its rows over the tasks first.

    Nulls are filled forward then backward in ``order_by`` order when given
    (the reference's preparation), otherwise rows with nulls are dropped.
    """
    from ..operators.nulls import impute_for_model

    order = [] if order_by is None else ([order_by] if isinstance(order_by, str) else list(order_by))
    cols = list(dict.fromkeys([key] + list(x_cols) + [y] + order))
    data = df.select(*[F.col(q(c)) for c in cols])
    if order:
        fill_cols = [c for c in cols if c not in order and c != key]
        data = impute_for_model(data, order, cols=fill_cols)
    data = data.select(*[F.col(q(c)) for c in dict.fromkeys([key] + list(x_cols) + [y])]).dropna()
    if task == "regression":
        data = data.withColumn(y, F.col(q(y)).cast("double"))
    if deal:
        data = data.repartition(*data.columns)
    # the split is held with the rows: its hash is taken once, not in every pass
    data = data.withColumn("__test", hash_unit(key) < F.lit(test_size)).persist(StorageLevel.MEMORY_AND_DISK)
    tr, te = (data.where(part).drop("__test") for part in (~F.col("__test"), F.col("__test")))
    prep = Pipeline(stages=prepare_stages(data, x_cols, y, task, scaler)).fit(tr)
    label = y if task == "regression" else "label"
    # learners read these alone; the vectors before scaling would fill the memory that holds them
    tr_x = prep.transform(tr).select(*[F.col(q(c)) for c in dict.fromkeys([key, label, "features"])]).persist(StorageLevel.MEMORY_AND_DISK)
    return Prepared(task, key, label, prep, tr_x, prep.transform(te),
                    len(prep.stages[-1].labels) if task == "classification" else None, [tr_x, data])


def fit(p: Prepared, kind: str, **options) -> TrainResult:
    """Fit one model on a prepared train split and score its test split; ``options`` go to the learner (``depth`` of trees, say)."""
    from . import cells, custom, forest, knn, perceptron, trees
    from .metrics import classification_metrics, regression_metrics

    tr_x, label, regression = p.train, p.label, p.task == "regression"
    est = spark_estimator(kind, p.task, _vector_size(tr_x) if kind == "mlp" else None, p.n_classes, options.get("depth"))
    if est is not None:
        est.setFeaturesCol("features").setLabelCol(label)
        room_for_levels(est, tr_x)
        if kind in ("xgboost", "gbt"):
            model = cells.fit_on_cells(est, tr_x, label)
        elif kind == "forest":
            model = forest.fit_forest(est, tr_x, label, p.n_classes or 0)
        elif kind == "mlp":
            model = perceptron.fit_perceptron(est, tr_x, label)
        else:
            model = est.fit(tr_x)
    elif kind == "tree":
        model = trees.fit_deep_tree(tr_x, label, p.task, n_classes=p.n_classes or 0, **options)
    elif kind == "knn":
        model = knn.KNNModel(tr_x, p.key, label, k=5, task=p.task)
    elif kind == "svr" and regression:
        model = custom.fit_linear_svr(tr_x, label, **options)
    elif kind == "sgd" and regression:
        model = custom.fit_sgd_regressor(tr_x, label, **options)
    elif kind == "svm" and not regression:
        model = custom.fit_rbf_svm(tr_x, label, p.n_classes, **options)
    elif kind == "adaboost" and not regression:
        model = custom.fit_adaboost(tr_x, label, p.n_classes, **options)
    else:
        raise ValueError(f"unknown {p.task} model {kind!r}")
    pred = model.transform(p.test)
    pred = pred.withColumn("prediction", F.col("prediction").cast("double"))
    if regression:
        metrics = regression_metrics(pred, label, "prediction")
    else:
        pred = pred.withColumn("label", F.col("label").cast("double"))
        metrics = classification_metrics(pred, "label", "prediction")
    return TrainResult(kind, p.task, p.prep, model, tr_x, p.test, pred, metrics, p.key)


def train(df: DataFrame, x_cols, y: str, kind: str, task: str, key: str, test_size: float = 0.2,
          scaler: str | None = "standard", order_by=None, **options) -> TrainResult:
    """Fit one model on the train split and score the test split."""
    prepared = prepare(df, x_cols, y, task, key, test_size, scaler, order_by, deal=kind in DEALT)
    try:
        return fit(prepared, kind, **options)
    finally:
        prepared.release()


def inverse_labels(prep: PipelineModel, pred: DataFrame, col: str = "prediction", out: str = "predicted_label"):
    """Map class indices back to the original labels (IndexToString)."""
    labels = prep.stages[-1].labels
    return MF.IndexToString(inputCol=col, outputCol=out, labels=labels).transform(
        pred.withColumn(col, F.col(col).cast("double")))
