"""Model metrics (M-20 .. M-22) as aggregates over a prediction frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.profile import attach_scalars
from ..operators.relational import q


def _long(one: DataFrame, names) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("metric"), F.round(F.col(n), 2).alias("value")) for n in names]
    return one.select(F.inline(F.array(*rows)))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       long: bool = True, with_rmse: bool = True) -> DataFrame:
    """M-20: MAE, MSE, RMSE, R², MAPE (zero actuals masked, in %), 2 decimals.

    Constant actuals: R² is 1 for a perfect prediction, else 0."""
    y = F.col(q(label)).cast("double")
    p = F.col(q(prediction)).cast("double")
    e = y - p
    one = pred.agg(F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"),
                   F.sum(e * e).alias("__sse"), F.var_pop(y).alias("__vy"), F.count(y).alias("__n"),
                   (F.avg(F.when(y != 0, F.abs(e / y))) * 100).alias("MAPE"))
    one = one.withColumn("RMSE", F.sqrt("MSE")).withColumn(
        "R2", F.when(F.col("__vy") * F.col("__n") != 0, 1 - F.col("__sse") / (F.col("__vy") * F.col("__n")))
        .when(F.col("__sse") == 0, 1.0).when(F.col("__sse") > 0, 0.0))
    names = ["MAE", "MSE"] + (["RMSE"] if with_rmse else []) + ["R2", "MAPE"]
    if long:
        return _long(one, names)
    return one.select(*[F.round(F.col(n), 2).alias(n) for n in names])


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(q(label)).alias("actual"), F.col(q(prediction)).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           long: bool = True) -> DataFrame:
    """M-21: accuracy and support-weighted precision / recall / F1, 2 decimals.

    One lineage: the confusion counts (classes² rows, one shuffle of tiny
    partial aggregates), per-class support and predicted totals as windows
    over that small table, then the diagonal.  A class without a correct
    prediction has precision = recall = F1 = 0, so only diagonal cells add to
    the weighted sums (and weighted recall equals accuracy)."""
    cc = confusion_counts(pred, label, prediction)
    w_actual = Window.partitionBy("actual")
    w_pred = Window.partitionBy("predicted")
    w_all = Window.partitionBy(F.lit(1))  # over classes² rows only
    cells = cc.select("actual", "predicted", "count",
                      F.sum("count").over(w_actual).alias("support"),
                      F.sum("count").over(w_pred).alias("npred"),
                      F.sum("count").over(w_all).alias("n"))
    diag = cells.where(F.col("actual") == F.col("predicted"))
    p = F.col("count") / F.col("npred")
    r = F.col("count") / F.col("support")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    one = diag.agg((F.sum("count") / F.first("n")).alias("Accuracy"),
                   (F.sum(p * F.col("support")) / F.first("n")).alias("Precision"),
                   (F.sum(r * F.col("support")) / F.first("n")).alias("Recall"),
                   (F.sum(f1 * F.col("support")) / F.first("n")).alias("F1 Score"))
    # no correct prediction at all: every metric is 0
    one = one.select(*[F.coalesce(F.col(q(c)), F.lit(0.0)).alias(c)
                       for c in ("Accuracy", "Precision", "Recall", "F1 Score")])
    names = ["Accuracy", "Precision", "Recall", "F1 Score"]
    if long:
        return _long(one, names)
    return one.select(*[F.round(F.col(q(n)), 2).alias(n) for n in names])


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction", labels=None) -> DataFrame:
    """M-22: (actual, predicted, count) for every pair of labels seen in either
    column, zeros included.  ``labels`` (those of the label indexer) maps class
    numbers back to the original labels."""
    cc = confusion_counts(pred, label, prediction)
    if labels is not None:
        names = F.array(*[F.lit(x) for x in labels])
        cc = cc.select(*[F.get(names, F.col(c).cast("int")).alias(c) for c in ("actual", "predicted")], "count")
    seen = (cc.select(F.col("actual").alias("l")).union(cc.select(F.col("predicted").alias("l")))
              .distinct().where(F.col("l").isNotNull()))
    # the label grid is classes² rows: built from the sorted label list of one small aggregate
    grid = seen.agg(F.sort_array(F.collect_set("l")).alias("ls")).select(
        F.explode("ls").alias("actual"), F.col("ls")).select("actual", F.explode("ls").alias("predicted"))
    return grid.join(cc, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
