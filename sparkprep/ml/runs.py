"""Training sessions, run log, batch scoring, input checks, PCA (M-23 .. M-27).

The run log replaces an external tracking server with an append-only Parquet
table ``<base>/_runs`` (one row per metric); batch scoring loads what
``ml.persist`` saved and is an ordinary DataFrame transform.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml import feature as MF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.features import scale
from ..operators.profile import feature_values
from ..operators.relational import kind_of, q
from . import core, persist

RUN_SCHEMA = ("run_id string, experiment string, model string, metric string, value double, "
              "tags map<string,string>, ts timestamp_ntz")


def train_many(df: DataFrame, x_cols, y: str, kinds, task: str, key: str, test_size: float = 0.2,
               scaler: str | None = "standard", order_by=None):
    """M-23: fit several models on the same split; returns ({kind: TrainResult},
    metrics frame with a ``model`` column).

    Split and preparation are computed once, from one scan of ``df``, and
    released at the end; the metrics (a few numbers a model) are computed before."""
    prepared = core.prepare(df, x_cols, y, task, key, test_size, scaler, order_by)
    results, rows = {}, []
    try:
        prepared.test = prepared.test.persist()
        prepared.held.append(prepared.test)
        for kind in kinds:
            r = results[kind] = core.fit(prepared, kind)
            own = [(kind, m["metric"], m["value"]) for m in r.metrics.collect()]
            rows += own
            r.metrics = df.sparkSession.createDataFrame([m[1:] for m in own], "metric string, value double")
    finally:
        prepared.release()
    return results, df.sparkSession.createDataFrame(rows, "model string, metric string, value double")


def runs_path(base: str) -> str:
    return f"{base.rstrip('/')}/_runs"


def log_run(spark: SparkSession, base: str, experiment: str, model: str, metrics: DataFrame,
            tags: dict | None = None, run_id: str | None = None) -> str:
    """M-24: append one run (its metric rows plus tags) to the run log."""
    run_id = run_id or uuid.uuid4().hex
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    tag_map = F.create_map(*[x for k, v in (tags or {}).items() for x in (F.lit(k), F.lit(str(v)))]) \
        if tags else F.create_map().cast("map<string,string>")
    rows = metrics.select(F.lit(run_id).alias("run_id"), F.lit(experiment).alias("experiment"),
                          F.lit(model).alias("model"), F.col("metric"), F.col("value").cast("double"),
                          tag_map.alias("tags"), F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz").alias("ts"))
    rows.write.mode("append").parquet(runs_path(base))
    return run_id


def runs(spark: SparkSession, base: str, experiment: str | None = None, tag: tuple | None = None) -> DataFrame:
    """M-24: the newest run per (experiment, model), filtered by experiment or tag."""
    log = spark.read.schema(RUN_SCHEMA).parquet(runs_path(base))
    if experiment is not None:
        log = log.where(F.col("experiment") == experiment)
    if tag is not None:
        log = log.where(F.col("tags")[tag[0]] == tag[1])
    latest = (log.groupBy("experiment", "model", "run_id").agg(F.max("ts").alias("ts"))
              .withColumn("__r", F.row_number().over(Window.partitionBy("experiment", "model")
                                                      .orderBy(F.col("ts").desc(), F.col("run_id"))))
              .where("__r = 1").select("run_id"))
    return log.join(latest, "run_id")


def save_model(result: core.TrainResult, path: str) -> str:
    """M-25: persist preparation and model of any learner in one folder."""
    return persist.save(result, path)


def score(path: str, df: DataFrame, inverse_labels: bool = True) -> DataFrame:
    """M-25: batch scoring with the stored preprocessing; class indices are
    mapped back to the training labels.  ``df`` needs no label column."""
    prep, model, about = persist.load(df.sparkSession, path)
    label = prep.stages[-1]
    indexed = isinstance(label, MF.StringIndexerModel) and label.getOutputCol() == "label"
    if indexed and label.getInputCol() not in df.columns:
        prep = PipelineModel(stages=prep.stages[:-1])
    elif indexed:
        label.setHandleInvalid("keep")  # a label that training never saw is no reason not to score its row
    out = model.transform(prep.transform(df))
    if inverse_labels and indexed:
        out = MF.IndexToString(inputCol="prediction", outputCol="predicted_label",
                               labels=label.labels).transform(out.withColumn("prediction", F.col("prediction").cast("double")))
    return out


def validate_inputs(df: DataFrame, training: DataFrame, cols) -> DataFrame:
    """M-26: rows of ``df`` that cannot be scored: a null feature or a
    categorical value never seen in ``training``.  Adds ``problem``."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cats = [c for c in cols if kind_of(fields[c]) != "numeric"]
    seen = feature_values(training, cats).withColumn("__seen", F.lit(True))
    out = df
    problems = []
    for i, c in enumerate(cols):
        problems.append(F.when(F.col(q(c)).isNull(), F.lit(f"{c}: missing")))
    for i, c in enumerate(cats):
        s = seen.where(F.col("feature") == c).select(F.col("value").alias(f"__v{i}"), F.col("__seen").alias(f"__s{i}"))
        out = out.join(s, F.col(q(c)).cast("string") == F.col(f"__v{i}"), "left")
        problems.append(F.when(F.col(q(c)).isNotNull() & F.col(f"__s{i}").isNull(), F.lit(f"{c}: unseen value")))
    reason = F.concat_ws("; ", *problems)
    return (out.withColumn("problem", reason).where(F.col("problem") != "")
            .select(*[F.col(q(c)) for c in df.columns], "problem"))


def pca2(df: DataFrame, cols, keep=()) -> DataFrame:
    """M-27: first two principal components of the standardised (population
    std) columns; each component's sign makes its largest loading positive."""
    z = scale(df.select(*keep, *cols), "standard", cols=list(cols), in_place=True)
    vec = MF.VectorAssembler(inputCols=list(cols), outputCol="__z").transform(z)
    model = MF.PCA(k=2, inputCol="__z", outputCol="__pc").fit(vec)
    pcs = model.pc.toArray()
    signs = []
    for j in range(2):
        col = pcs[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    arr = vector_to_array(F.col("__pc"))
    return model.transform(vec).select(*keep, (arr[0] * signs[0]).alias("PC1"), (arr[1] * signs[1]).alias("PC2"))
