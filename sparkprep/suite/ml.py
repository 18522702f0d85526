"""Checked queries for model pipelines (M-*).

Exact-by-construction operators (split, k-NN, one-feature least squares,
metrics and confusion tables over them) have DuckDB twins; the iterative
learners are registered rows-only and covered by property tests.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..ml import core as M
from ..ml import knn as K
from ..ml import metrics as MT
from .base import r4, register, table

_HASH_UNIT = "(('0x' || substr(md5({k}::VARCHAR || ':42'), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"


def _emb_split(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>"))
                                              .alias("features"), F.col("label").cast("double").alias("label"))
    return M.split(e, "vec_id", 0.2)


_EMB = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::DOUBLE AS label,
  {_HASH_UNIT.format(k='vec_id')} < 0.2 AS is_test FROM embeddings),
nn AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rk
  FROM e q JOIN e t ON q.is_test AND NOT t.is_test)"""

_KNN_CLF = f"""WITH {_EMB},
votes AS (SELECT qid, label, count(*) AS n FROM nn WHERE rk <= 5 GROUP BY qid, label),
pred AS (SELECT qid, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY qid
          ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1),
p AS (SELECT e.vec_id, e.label, pred.prediction FROM e JOIN pred ON e.vec_id = pred.qid)"""


@register("m01_split", f"""
SELECT *, CASE WHEN {_HASH_UNIT.format(k='o_orderkey')} < 0.25 THEN 'test' ELSE 'train' END AS split FROM orders""")
def m01_split(spark, sf):
    return M.with_split(table(spark, sf, "orders"), "o_orderkey", 0.25)


@register("m04_linear_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def m04_linear_regression(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    li = table(spark, sf, "lineitem")
    x = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li)
    model = LinearRegression(solver="normal", regParam=0.0, labelCol="l_extendedprice").fit(x)
    return r4(spark.range(1).select(F.lit(float(model.coefficients[0])).alias("slope"),
                                     F.lit(float(model.intercept)).alias("intercept")))


@register("m09_knn_regressor", f"""
WITH {_EMB}
SELECT qid AS vec_id, round(avg(label), 4) AS prediction FROM nn WHERE rk <= 5 GROUP BY qid""")
def m09_knn_regressor(spark, sf):
    tr, te = _emb_split(spark, sf)
    model = K.KNNModel(tr, "vec_id", "label", k=5, task="regression")
    return r4(model.transform(te.select("vec_id", "features")).select("vec_id", "prediction"))


@register("m14_knn_classifier", f"{_KNN_CLF}\nSELECT vec_id, label, prediction FROM p")
def m14_knn_classifier(spark, sf):
    tr, te = _emb_split(spark, sf)
    model = K.KNNModel(tr, "vec_id", "label", k=5, task="classification")
    return model.transform(te).select("vec_id", "label", "prediction")


@register("m20_regression_metrics", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
           FROM lineitem),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, f)
SELECT 'MAE' AS metric, round(avg(abs(y - yhat)), 2) AS value FROM p
UNION ALL SELECT 'MSE', round(avg((y - yhat) * (y - yhat)), 2) FROM p
UNION ALL SELECT 'RMSE', round(sqrt(avg((y - yhat) * (y - yhat))), 2) FROM p
UNION ALL SELECT 'R2', round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)), 2) FROM p
UNION ALL SELECT 'MAPE', round(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100, 2) FROM p""")
def m20_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    coef = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
                  F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    from ..operators.profile import attach_scalars
    pred = attach_scalars(li, coef).select(F.col("l_extendedprice").alias("label"),
                                           (F.col("a") + F.col("b") * F.col("l_quantity")).alias("prediction"))
    return MT.regression_metrics(pred, "label", "prediction")


def _knn_clf_pred(spark, sf):
    tr, te = _emb_split(spark, sf)
    return K.KNNModel(tr, "vec_id", "label", k=5, task="classification").transform(te)


@register("m21_classification_metrics", f"""{_KNN_CLF},
cc AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM p GROUP BY 1, 2),
tot AS (SELECT sum(n) AS total FROM cc),
cls AS (SELECT actual AS c FROM cc UNION SELECT predicted FROM cc),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cc WHERE actual = c), 0) AS support,
          coalesce((SELECT sum(n) FROM cc WHERE predicted = c), 0) AS npred,
          coalesce((SELECT sum(n) FROM cc WHERE actual = c AND predicted = c), 0) AS tp FROM cls),
m AS (SELECT tp, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per)
SELECT 'Accuracy' AS metric, round(sum(tp) / (SELECT total FROM tot), 2) AS value FROM m
UNION ALL SELECT 'Precision', round(sum(pr * support) / (SELECT total FROM tot), 2) FROM m
UNION ALL SELECT 'Recall', round(sum(rc * support) / (SELECT total FROM tot), 2) FROM m
UNION ALL SELECT 'F1 Score', round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * support)
   / (SELECT total FROM tot), 2) FROM m""")
def m21_classification_metrics(spark, sf):
    return MT.classification_metrics(_knn_clf_pred(spark, sf), "label", "prediction")


@register("m22_confusion", f"""{_KNN_CLF},
cc AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM p GROUP BY 1, 2),
ls AS (SELECT actual AS l FROM cc UNION SELECT predicted FROM cc)
SELECT a.l AS actual, b.l AS predicted, coalesce(cc.n, 0)::BIGINT AS count
FROM ls a CROSS JOIN ls b LEFT JOIN cc ON cc.actual = a.l AND cc.predicted = b.l""")
def m22_confusion(spark, sf):
    return MT.confusion_matrix(_knn_clf_pred(spark, sf), "label", "prediction")


@register("m22_confusion_labels", f"""{_KNN_CLF},
c AS (SELECT 'class ' || label::INT AS actual, 'class ' || prediction::INT AS predicted FROM p),
cc AS (SELECT actual, predicted, count(*) AS n FROM c GROUP BY 1, 2),
ls AS (SELECT actual AS l FROM cc UNION SELECT predicted FROM cc)
SELECT a.l AS actual, b.l AS predicted, coalesce(cc.n, 0)::BIGINT AS count
FROM ls a CROSS JOIN ls b LEFT JOIN cc ON cc.actual = a.l AND cc.predicted = b.l""")
def m22_confusion_labels(spark, sf):
    """Class numbers come back as the labels that were indexed."""
    top = int(table(spark, sf, "embeddings").agg(F.max("label")).first()[0])
    return MT.confusion_matrix(_knn_clf_pred(spark, sf), "label", "prediction", labels=[f"class {i}" for i in range(top + 1)])


@register("m26_validate_numeric", """
SELECT l_orderkey, l_linenumber, 'l_tax: missing' AS problem FROM lineitem WHERE l_tax = 0.05""")
def m26_validate_numeric(spark, sf):
    """Numeric features only: the one problem is a missing value."""
    from ..ml.runs import validate_inputs
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    holes = li.withColumn("l_tax", F.when(F.col("l_tax") != 0.05, F.col("l_tax")))
    return validate_inputs(holes, li, ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "problem")


# ---- iterative learners: rows-only (property tests in tests/test_ml.py) -------------------

X_REG = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
X_CLF = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment"]


def lineitem_regression(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.select(key.alias("row_key"), *X_REG, "l_extendedprice")


def orders_classification(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", *X_CLF, "o_orderstatus")


def documents_binary(spark, sf):
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(doc, "doc_id").select("doc_id", "n_chars", "lang", "quality", F.col("toxic").cast("string")
                                          .alias("toxic"))


def _reg(kind, scaler="standard"):
    def run(spark, sf):
        return M.train(lineitem_regression(spark, sf), X_REG, "l_extendedprice", kind, "regression",
                       "row_key", 0.2, scaler).metrics
    return run


def _clf(kind, binary=False):
    def run(spark, sf):
        if binary:
            return M.train(documents_binary(spark, sf), ["n_chars", "lang", "quality"], "toxic", kind,
                           "classification", "doc_id", 0.25, "standard").metrics
        return M.train(orders_classification(spark, sf), X_CLF, "o_orderstatus", kind, "classification",
                       "o_orderkey", 0.2, "standard").metrics
    return run


@register("m02_features")
def m02_features(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = lineitem_regression(spark, sf)
    stages = M.feature_stages(df, X_REG, "regression")
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.select("row_key", vector_to_array("features_raw").alias("features"), "l_extendedprice")


@register("m03_scaler")
def m03_scaler(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = lineitem_regression(spark, sf)
    tr, _ = M.split(df, "row_key", 0.2)
    stages = M.feature_stages(df, X_REG, "regression") + [M.scaler_stage("robust")]
    model = Pipeline(stages=stages).fit(tr)  # fitted on the training part only
    return model.transform(df).select("row_key", vector_to_array("features").alias("features"))


@register("m02_feature_columns", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS f0, l_discount::DOUBLE AS f1, l_returnflag, l_linestatus FROM lineitem),
r AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS k FROM (SELECT DISTINCT l_returnflag FROM l)),
s AS (SELECT l_linestatus, row_number() OVER (ORDER BY l_linestatus) - 1 AS k FROM (SELECT DISTINCT l_linestatus FROM l))
SELECT l_orderkey, l_linenumber, f0, f1, (r.k = 0)::INT::DOUBLE AS f2, (r.k = 1)::INT::DOUBLE AS f3, (r.k = 2)::INT::DOUBLE AS f4,
       (s.k = 0)::INT::DOUBLE AS f5, (s.k = 1)::INT::DOUBLE AS f6
FROM l JOIN r USING (l_returnflag) JOIN s USING (l_linestatus)""")
def m02_feature_columns(spark, sf):
    """The assembled vector, one column a component: numbers as they are, then the levels of each text column in order."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    stages = M.feature_stages(df, ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"], "regression")
    v = Pipeline(stages=stages).fit(df).transform(df).withColumn("v", vector_to_array("features_raw"))
    return v.select("l_orderkey", "l_linenumber", *[F.col("v")[i].alias(f"f{i}") for i in range(7)])


#: Centre and spread of each scaler in SQL.
_SCALERS = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"),
            "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}


def _scaler_sql(kind):
    cols = ("l_quantity", "l_extendedprice", "constant")
    stats = ", ".join(f"{e.format(c=c)} AS {n}_{c}" for c in cols for n, e in zip("cs", _SCALERS[kind]))
    out = ", ".join(f"round(({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 4) AS {c}_scaled" for c in cols)
    return f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, 7.0::DOUBLE AS constant,
                  {_HASH_UNIT.format(k='l_orderkey')} >= 0.2 AS train FROM lineitem),
s AS (SELECT {stats} FROM l WHERE train)
SELECT l_orderkey, l_linenumber, {out} FROM l, s"""


def _scaled(kind):
    def run(spark, sf):
        """A scaler stage fitted on the training part and applied to all rows, a constant column among them."""
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        cols = ["l_quantity", "l_extendedprice", "constant"]
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").withColumn("constant", F.lit(7.0))
        tr, _ = M.split(df, "l_orderkey", 0.2)
        stages = [VectorAssembler(inputCols=cols, outputCol="features_raw"), M.scaler_stage(kind)]
        out = Pipeline(stages=stages).fit(tr).transform(df).withColumn("v", vector_to_array("features"))
        return r4(out.select("l_orderkey", "l_linenumber", *[F.col("v")[i].alias(f"{c}_scaled") for i, c in enumerate(cols)]))
    return run


for _kind in _SCALERS:
    register(f"m03_scaler_{_kind}", _scaler_sql(_kind))(_scaled(_kind))


@register("m11_sgd_one_feature", """
WITH w AS (SELECT covar_pop(l_extendedprice, l_quantity) / (var_pop(l_quantity) + 0.0001) AS slope,
                  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
SELECT round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM w""")
def m11_sgd_one_feature(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from ..ml.custom import fit_sgd_regressor
    x = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(table(spark, sf, "lineitem"))
    model = fit_sgd_regressor(x, "l_extendedprice")
    return r4(spark.createDataFrame([(float(model.coef[0]), model.intercept)], "slope double, intercept double"))


register("m05_xgboost_regressor")(_reg("xgboost"))
register("m06_tree_regressor")(_reg("tree"))
register("m07_forest_regressor")(_reg("forest"))
register("m08_gbt_regressor")(_reg("gbt"))
register("m10_linear_svr")(_reg("svr"))
register("m11_sgd_regressor")(_reg("sgd"))
register("m12_logistic")(_clf("logistic"))
register("m12_logistic_binary")(_clf("logistic", binary=True))
register("m13_tree_classifier")(_clf("tree"))
register("m13_forest_classifier")(_clf("forest"))
register("m15_naive_bayes")(_clf("nb"))
register("m16_svm_rbf")(_clf("svm"))
register("m17_gbt_classifier")(_clf("gbt"))
register("m17_gbt_classifier_binary")(_clf("gbt", binary=True))
register("m18_adaboost")(_clf("adaboost"))
register("m19_mlp")(_clf("mlp"))


@register("m23_train_many")
def m23_train_many(spark, sf):
    from ..ml.runs import train_many
    _, metrics = train_many(lineitem_regression(spark, sf), X_REG, "l_extendedprice", ["linear", "tree", "sgd"],
                            "regression", "row_key", 0.2, "minmax")
    return metrics


def _shared_dir(spark, name):
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


@register("m24_run_log")
def m24_run_log(spark, sf):
    from ..ml.runs import log_run, runs
    import uuid
    base = _shared_dir(spark, f"runlog-{uuid.uuid4().hex}")
    res = M.train(lineitem_regression(spark, sf), X_REG, "l_extendedprice", "linear", "regression", "row_key")
    log_run(spark, base, "lineitem-price", "linear", res.metrics, {"scaler": "standard"})
    log_run(spark, base, "lineitem-price", "linear", res.metrics, {"scaler": "standard", "note": "rerun"})
    return runs(spark, base, "lineitem-price")


@register("m25_score")
def m25_score(spark, sf):
    from ..ml.runs import save_model, score
    import uuid
    data = orders_classification(spark, sf)
    res = M.train(data, X_CLF, "o_orderstatus", "tree", "classification", "o_orderkey")
    path = save_model(res, _shared_dir(spark, f"model-{uuid.uuid4().hex}"))
    return score(path, data).select("o_orderkey", "o_orderstatus", "predicted_label")


@register("m25_score_linear", f"""
WITH o AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, o_totalprice, {_HASH_UNIT.format(k='o_orderkey')} >= 0.2 AS train FROM orders),
m AS (SELECT regr_slope(o_totalprice, x) AS b, regr_intercept(o_totalprice, x) AS a FROM o WHERE train)
SELECT o_orderkey, round(a + b * x, 2) AS prediction FROM o, m""")
def m25_score_linear(spark, sf):
    """A regression is trained, saved, opened again and applied to the table without its label."""
    from ..ml.runs import save_model, score
    import uuid
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), "o_totalprice")
    res = M.train(o, ["o_custkey"], "o_totalprice", "linear", "regression", "o_orderkey", 0.2, "standard")
    path = save_model(res, _shared_dir(spark, f"model-{uuid.uuid4().hex}"))
    return score(path, o.drop("o_totalprice")).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register("m26_validate_inputs", """
WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderpriority <> '5-LOW'),
sc AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT sc.*, 'o_orderpriority: unseen value' AS problem FROM sc
WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM tr)""")
def m26_validate_inputs(spark, sf):
    from ..ml.runs import validate_inputs
    o = table(spark, sf, "orders")
    tr = o.where("o_orderdate < timestamp_ntz'1998-01-01' AND o_orderpriority <> '5-LOW'")
    sc = o.where("o_orderdate >= timestamp_ntz'1998-01-01'")
    return validate_inputs(sc, tr, ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@register("m27_pca")
def m27_pca(spark, sf):
    from ..ml.runs import pca2
    return pca2(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                keep=["l_orderkey", "l_linenumber"])


@register("c10_actual_vs_predicted")
def c10_actual_vs_predicted(spark, sf):
    from ..operators.charts import actual_vs_predicted
    res = M.train(lineitem_regression(spark, sf), X_REG, "l_extendedprice", "linear", "regression", "row_key")
    return actual_vs_predicted(res.predictions, "row_key", "l_extendedprice", "prediction")
