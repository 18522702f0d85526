"""Semantic edge cases of projection / filter / merge / duplicates, pandas as second oracle."""

import math

import pandas as pd

from sparkprep.operators import aggregate as A
from sparkprep.operators import relational as R


def rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_filter_null_rules(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, s string")
    keep_ne = R.filter_conditions(df, {"c1": ("s", "!=", "a")})
    assert sorted(r.id for r in keep_ne.collect()) == [1, 3]  # pandas: NaN != 'a' is True
    keep_eq = R.filter_conditions(df, {"c1": ("s", "==", "a")})
    assert [r.id for r in keep_eq.collect()] == [2]
    neg = R.filter_conditions(df, {"c1": ("s", "==", "a"), "C2": ("id", ">", 2)}, "~c1 & ~C2")
    assert sorted(r.id for r in neg.collect()) == [1]


def test_merge_matches_pandas(spark):
    left = pd.DataFrame({"k": [1.0, 2.0, None, 4.0], "v": [10, 20, 30, 40]})
    right = pd.DataFrame({"k": [1.0, None, 5.0], "v": [100, 300, 500], "w": ["a", "c", "e"]})
    for how in ("inner", "left", "right", "outer"):
        exp = pd.merge(left, right, on="k", how=how)
        got = R.merge(spark.createDataFrame(left.astype(object).where(left.notna(), None), "k double, v long"),
                      spark.createDataFrame(right.astype(object).where(right.notna(), None),
                                            "k double, v long, w string"), "k", how=how).toPandas()
        assert list(got.columns) == list(exp.columns)
        norm = lambda d: sorted((tuple(repr(None if (isinstance(x, float) and math.isnan(x)) else x) for x in r)
                                 for r in d.itertuples(index=False)))
        assert norm(got) == norm(exp), how


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "y")], "a int, b string")
    assert R.duplicate_count(df).first()[0] == 1
    assert len(R.duplicate_rows(df).collect()) == 2
    assert R.drop_duplicates(df).count() == 3


def test_group_agg_semantics(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", None, None), (None, 9, 1.0),
                                ("b", None, None)], "k string, t int, v double")
    out = {r.k: r for r in A.group_agg(df, "k", {"v": ["sum", "count", "size", "first", "last", "nunique"]},
                                       order_by="t").collect()}
    assert set(out) == {"a", "b"}  # null key dropped
    assert out["b"].v_sum == 0  # all-null sum is 0
    assert out["a"].v_count == 1 and out["a"].v_size == 3
    assert out["a"].v_first == 5.0 and out["a"].v_last == 5.0
    assert out["b"].v_first is None


def test_value_counts_and_mode(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), (None,), ("z",)], "c string")
    vc = [tuple(r) for r in R.value_counts(df, "c").collect()]
    assert vc[0] == ("y", 2) and len(vc) == 3
    assert R.mode_value(df, "c", least=True).first()["value"] == "x"  # tie → smallest


def test_concat_first_seen_order(spark):
    a = spark.createDataFrame([(1, "p")], "x int, y string")
    b = spark.createDataFrame([(2, True)], "x int, z boolean")
    out = R.concat([a, b])
    assert out.columns == ["x", "y", "z"] and out.count() == 2


def test_merge_spreads_null_keys_and_keeps_every_row(spark):
    """Many null keys on either side, both or none, one key or two: pandas's rows, and no task holds all of the left's."""
    for nl, nr in ((40, 0), (40, 3), (2, 30), (0, 25), (0, 0)):
        left = [(None, None, i) for i in range(nl)] + [(None, 5, 900), (7, None, 901), (1, 1, 902), (2, 2, 903), (2, 2, 904)]
        right = [(None, None, -i) for i in range(nr)] + [(None, 6, -900), (None, 5, -901), (1, 1, -902), (3, 3, -903)]
        l, r = spark.createDataFrame(left, "a int, b int, v int"), spark.createDataFrame(right, "a int, b int, w int")
        for keys in (["a"], ["a", "b"]):
            at = [["a", "b"].index(k) for k in keys]
            same = lambda x, y: all(x[i] == y[i] for i in at)
            pairs = [(x[2], y[2]) for x in left for y in right if same(x, y)]
            lone_l = [(x[2], None) for x in left if not any(same(x, y) for y in right)]
            lone_r = [(None, y[2]) for y in right if not any(same(x, y) for x in left)]
            for how, want in (("inner", pairs), ("left", pairs + lone_l), ("right", pairs + lone_r), ("outer", pairs + lone_l + lone_r)):
                got = R.merge(l, r, keys, None, how).select("v", "w").collect()
                assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)), (nl, nr, keys, how)


def test_null_keys_of_a_right_merge_lie_in_many_tasks(spark):
    from pyspark.sql import functions as F
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left = spark.range(4000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
        right = spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").alias("w"))
        held = R.merge(left, right, "k", None, "right").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in held) == 4002 and max(r["count"] for r in held) < 2500
