"""SMOTE-NC oversampling (O-07).

Every class smaller than the majority is grown to the majority size with
synthetic rows.  Per class:

* neighbours: exact k-NN inside the class (``ml.knn``, self excluded); a
  categorical mismatch costs the median of the class's numeric standard
  deviations.  Categoricals travel as exact level codes, so a column may have
  any number of levels;
* draw ``j`` picks base row ``md5(j:seed) mod n``, neighbour rank
  ``md5(j:seed:nn) mod k``, and ``u = md5(j:seed:u)`` in [0, 1): numerics are
  ``x + u·(neighbour − x)``, categoricals the most frequent value among the
  base row's k neighbours (ties → smallest).

The numbered rows and the neighbour table are written once and read by every
step after.  Everything is joins and aggregates over the class rows and the
draws; only per-class sizes and standard deviations reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features import levels
from ..operators.outliers import hash_int
from ..operators.relational import kind_of, q
from ..plans import ordered as O
from ..session import cut_lineage
from .knn import KNNIndex


def _unit(expr_text):
    return hash_int(expr_text).cast("double") / F.lit(float(1 << 60))


def smote_nc(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 10, numeric=None,
             categorical=None) -> DataFrame:
    """O-07: original rows plus synthetic rows; adds ``synthetic`` (boolean)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    feats = [c for c in df.columns if c not in (target, key)]
    numeric = numeric or [c for c in feats if kind_of(fields[c]) == "numeric"]
    categorical = categorical or [c for c in feats if c not in numeric]
    data = df.dropna()
    sizes = {r[0]: r[1] for r in data.groupBy(target).count().collect()}  # one row per class
    majority = max(sizes.values())
    parts = [data.withColumn("synthetic", F.lit(False))]
    for cls, n in sorted(sizes.items(), key=lambda kv: str(kv[0])):
        need = majority - n
        if need <= 0 or n < 2:
            continue
        members = data.where(F.col(q(target)) == F.lit(cls))
        parts.append(_grow(members, cls, need, target, key, numeric, categorical, min(k, n - 1), seed))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _grow(members, cls, need, target, key, numeric, categorical, k, seed):
    spark = members.sparkSession
    stds = members.agg(*[F.stddev_pop(F.col(q(c)).cast("double")).alias(c) for c in numeric]).first()
    med = float(sorted(stds[c] or 0.0 for c in numeric)[len(numeric) // 2]) if numeric else 1.0
    if numeric and len(numeric) % 2 == 0:
        vals = sorted(stds[c] or 0.0 for c in numeric)
        med = (vals[len(vals) // 2 - 1] + vals[len(vals) // 2]) / 2
    coded = members
    for i, c in enumerate(categorical):
        lv = levels(members, c).select(F.col("level").alias(f"__l{i}"), F.col("code").alias(f"__c{i}"))
        coded = coded.join(lv, F.col(q(c)) == F.col(f"__l{i}")).drop(f"__l{i}")
    vec = F.array(*[F.col(q(c)).cast("double") for c in numeric], *[F.col(f"__c{i}").cast("double") for i in range(len(categorical))])
    indexed = cut_lineage(O.with_row_index(coded.withColumn("__vec", vec), [key], name="__i"))
    points = indexed.select("__i", "__vec")
    index = KNNIndex(points, "__i", "__vec", categorical=len(categorical), mismatch=med)
    nn = cut_lineage(index.query(points, "__i", k=k, features="__vec", exclude_self=True))
    n = indexed.count()
    draws = spark.range(need).select(F.col("id").alias("__j"))
    tag = F.concat(F.col("__j").cast("string"), F.lit(f":{seed}"))
    draws = draws.select("__j", F.pmod(hash_int(tag), F.lit(n)).alias("qid"),
                         (F.pmod(hash_int(F.concat(tag, F.lit(":nn"))), F.lit(k)) + 1).cast("int").alias("rank"),
                         _unit(F.concat(tag, F.lit(":u"))).alias("__u"))
    pick = draws.join(nn.select("qid", "rank", "tid"), ["qid", "rank"])
    rows = indexed.select("__i", *[F.col(q(c)) for c in numeric + categorical])
    base = rows.select(F.col("__i").alias("qid"), *[F.col(q(c)).alias(f"__b_{c}") for c in numeric])
    other = rows.select(F.col("__i").alias("tid"), *[F.col(q(c)).alias(f"__n_{c}") for c in numeric])
    syn = pick.join(base, "qid").join(other, "tid")
    out_cols = [(F.col(f"__b_{c}") + F.col("__u") * (F.col(f"__n_{c}") - F.col(f"__b_{c}"))).alias(c)
                for c in numeric]
    syn = syn.select("__j", "qid", *out_cols)
    for c in categorical:
        votes = (nn.select("qid", "tid").join(rows.select(F.col("__i").alias("tid"), F.col(q(c)).alias("__v")), "tid")
                 .groupBy("qid", "__v").count())
        w = Window.partitionBy("qid").orderBy(F.col("count").desc(), F.col("__v").asc())
        mode = votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("qid", F.col("__v").alias(c))
        syn = syn.join(mode, "qid")
    key_type = members.schema[key].dataType
    syn = syn.select(F.lit(None).cast(key_type).alias(key), F.lit(cls).cast(members.schema[target].dataType)
                     .alias(target), *[F.col(q(c)) for c in numeric + categorical])
    cast_back = [F.col(q(c)).cast(members.schema[c].dataType).alias(c) if c in numeric else F.col(q(c))
                 for c in members.columns]
    return syn.select(*cast_back).withColumn("synthetic", F.lit(True))
