"""The distributed ordered core equals plain global windows, for any chunk/bucket sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkprep.operators import nulls as N
from sparkprep.operators import windows as W
from sparkprep.plans import ordered as O
from sparkprep.session import cut_lineage


@pytest.fixture(scope="module")
def ev(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return df.withColumn("value", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("value")))


@pytest.mark.parametrize("buckets", [1, 3, 17])
def test_row_index_is_dense_and_ordered(ev, buckets):
    idx = O.with_row_index(ev, ["ts", "event_id"], n_buckets=buckets).toPandas()
    idx = idx.sort_values(["ts", "event_id"]).reset_index(drop=True)
    assert list(idx["__idx"]) == list(range(len(idx)))


@pytest.mark.parametrize("chunk", [7, 50, 100000])
def test_rolling_matches_pandas(ev, chunk):
    got = W.rolling(ev, "value", 4, "mean", 2, order_by=["ts", "event_id"], chunk_rows=chunk).toPandas()
    got = got.sort_values(["ts", "event_id"]).reset_index(drop=True)
    exp = got["value"].rolling(4, min_periods=2).mean()
    assert ((got["value_mean_rolling"] - exp).abs().fillna(0) < 1e-9).all()
    assert got["value_mean_rolling"].isna().sum() == exp.isna().sum()


@pytest.mark.parametrize("center,window", [(True, 3), (True, 4), (False, 5)])
def test_rolling_center_and_median(ev, center, window):
    got = W.rolling(ev, "value", window, ["median", "sum"], 1, center=center, order_by=["ts", "event_id"],
                    chunk_rows=64).toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    r = got["value"].rolling(window, min_periods=1, center=center)
    assert ((got["value_median_rolling"] - r.median()).abs().fillna(0) < 1e-9).all()
    assert ((got["value_sum_rolling"] - r.sum()).abs().fillna(0) < 1e-9).all()


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_ffill_bfill_match_pandas(ev, buckets):
    base = ev.toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    f = N.ffill(ev, ["value"], ["ts", "event_id"], n_buckets=buckets).toPandas()
    f = f.sort_values(["ts", "event_id"]).reset_index(drop=True)
    assert ((f["value"] - base["value"].ffill()).abs().fillna(0) < 1e-12).all()
    b = N.bfill(ev, ["value"], ["ts", "event_id"], partition_by="user_id", n_buckets=buckets).toPandas()
    b = b.sort_values(["ts", "event_id"]).reset_index(drop=True)
    exp = base.groupby("user_id")["value"].bfill()
    assert ((b["value"] - exp).abs().fillna(0) < 1e-12).all()
    assert b["value"].isna().sum() == exp.isna().sum()


def test_no_fill_reads_the_rest_of_a_bucket_for_every_row(ev):
    """A frame from the current row to the end of its bucket costs the square of the bucket."""
    for df in (N.bfill(ev, ["value"], ["ts", "event_id"], n_buckets=3), N.impute_for_model(ev, ["ts", "event_id"], cols=["value"])):
        plan = df._jdf.queryExecution().executedPlan().toString().lower().replace(" ", "")
        assert "unboundedpreceding$(),currentrow$()" in plan and "currentrow$(),unboundedfollowing$()" not in plan


@pytest.mark.parametrize("keys", [None, "user_id"])
def test_imputed_is_filled_forward_then_backward(ev, keys):
    holes = ev.withColumn("value", F.when(F.col("event_id") > 120, F.col("value")))
    base = holes.toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    want = base.groupby("user_id")["value"].transform(lambda v: v.ffill().bfill()) if keys else base["value"].ffill().bfill()
    got = N.impute_for_model(holes, ["ts", "event_id"], ["value"], keys).toPandas().sort_values(["ts", "event_id"])["value"]
    assert np.array_equal(got.to_numpy(), want.to_numpy(), equal_nan=True)


def test_shift_diff_keyed(ev):
    got = W.shift(ev, "value", 2, ["ts", "event_id"], "user_id", chunk_rows=31).toPandas()
    got = got.sort_values(["ts", "event_id"]).reset_index(drop=True)
    exp = got.groupby("user_id")["value"].shift(2)
    assert ((got["value_shifted_2"] - exp).abs().fillna(0) < 1e-12).all()
    d = W.diff(ev, "value", 1, ["ts", "event_id"], chunk_rows=13).toPandas()
    d = d.sort_values(["ts", "event_id"]).reset_index(drop=True)
    assert ((d["value_diff"] - d["value"].diff(1)).abs().fillna(0) < 1e-9).all()


def test_no_single_partition_exchange_on_data_path(ev):
    plan = W.rolling(ev, "value", 5, order_by=["ts", "event_id"], chunk_rows=100)._jdf.queryExecution() \
        .executedPlan().toString()
    # only the P-row offsets table may be gathered into one partition
    assert "rangepartitioning" not in plan.lower()
    plain = ev.withColumn("r", F.avg("value").over(Window.orderBy("ts").rowsBetween(-4, 0)))
    assert "SinglePartition" in plain._jdf.queryExecution().executedPlan().toString()


def test_same_result_for_one_and_many_partitions(spark, ev):
    one = N.ffill(ev.coalesce(1), ["value"], ["ts", "event_id"]).orderBy("event_id").collect()
    many = N.ffill(ev.repartition(8), ["value"], ["ts", "event_id"]).orderBy("event_id").collect()
    assert one == many


@pytest.mark.parametrize("buckets", [1, 5, 23])
def test_series_index_with_a_hot_and_a_null_series(ev, buckets):
    # a third of the rows in series 0, some rows without a series key
    keyed = ev.withColumn("s", F.when(F.col("event_id") % 3 == 0, F.lit(0))
                          .when(F.col("event_id") % 17 == 1, F.lit(None))
                          .otherwise(F.col("user_id") % 4 + 1))
    got = O.series_index(keyed, ["ts", "event_id"], "s", n_buckets=buckets, size_name="n").toPandas()
    assert len(got) == keyed.count()
    exp = got.sort_values(["ts", "event_id"]).groupby("s", dropna=False).cumcount()
    assert (got["__pos"] == exp.reindex(got.index)).all()
    assert (got["n"] == got.groupby("s", dropna=False)["ts"].transform("size")).all()


@pytest.mark.parametrize("buckets", [1, 6])
def test_keyed_ffill_with_hot_and_null_series(ev, buckets):
    keyed = ev.withColumn("s", F.when(F.col("event_id") % 3 == 0, F.lit(0))
                          .when(F.col("event_id") % 17 == 1, F.lit(None))
                          .otherwise(F.col("user_id") % 4 + 1))
    base = keyed.toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    got = N.ffill(keyed, ["value"], ["ts", "event_id"], partition_by="s", n_buckets=buckets).toPandas()
    got = got.sort_values(["ts", "event_id"]).reset_index(drop=True)
    exp = base.groupby("s", dropna=False)["value"].ffill()
    assert ((got["value"] - exp).abs().fillna(0) < 1e-12).all()
    assert got["value"].isna().sum() == exp.isna().sum()


@pytest.fixture(scope="module")
def many(spark):
    """60 000 rows of 40 series, a third of them in one; times repeat, ids break ties."""
    r = np.random.default_rng(12)
    n = 60_000
    pdf = pd.DataFrame({"s": np.where(r.random(n) < 0.33, 0, r.integers(1, 40, n)), "t": r.integers(0, 5000, n) / 7, "id": r.permutation(n),
                        "v": np.where(r.random(n) < 0.3, np.nan, r.normal(size=n))})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))).withColumn("s", F.when(F.col("s") != 7, F.col("s")))
    return cut_lineage(df), pdf.assign(s=pdf.s.where(pdf.s != 7))


def test_20000_buckets_on_8_shuffle_partitions(many):
    """Two levels of boundaries: no bucket exceeds its bound, and results equal pandas."""
    df, pdf = many
    n, buckets = len(pdf), 20_000
    b = O.with_bucket(df, ["t", "id"], "s", n_buckets=buckets)
    sizes = b.groupBy("__bucket").agg(F.count("*").alias("n"), F.min(F.struct("s", "t", "id")).alias("lo"), F.max(F.struct("s", "t", "id")).alias("hi"))
    got = sizes.orderBy("__bucket").collect()
    assert len(got) > buckets / 2 and max(r.n for r in got) <= 6 * n / buckets
    key = [((r.lo.s is not None, r.lo.s or 0, r.lo.t, r.lo.id), (r.hi.s is not None, r.hi.s or 0, r.hi.t, r.hi.id)) for r in got]
    assert all(a[1] < b[0] for a, b in zip(key, key[1:]))  # ranges do not overlap
    idx = O.with_row_index(df, ["t", "id"], "s", n_buckets=buckets).toPandas()
    assert (idx.sort_values(["s", "t", "id"], na_position="first")["__idx"].to_numpy() == np.arange(n)).all()
    f = O.fill(df, ["v"], ["t", "id"], "s", n_buckets=buckets).toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["t", "id"]).groupby("s", dropna=False)["v"].ffill()
    assert np.allclose(f["v"].to_numpy(), pdf.assign(w=want).set_index("id").sort_index()["w"].to_numpy(), equal_nan=True)


def test_buckets_follow_the_rows(many, monkeypatch):
    """Few rows a bucket: as many buckets and shuffle partitions, without being told a number."""
    df, pdf = many
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 500)
    b = O.with_bucket(df, ["t", "id"])
    assert b.rdd.getNumPartitions() == 120
    assert b.groupBy("__bucket").count().agg(F.max("count")).first()[0] <= 1000
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CASE WHEN (__key" in plan
    got = W.rolling(df, "v", 4, "sum", 1, order_by=["t", "id"], chunk_rows=300).toPandas().sort_values(["t", "id"])
    assert np.allclose(got["v_sum_rolling"], got["v"].rolling(4, min_periods=1).sum(), equal_nan=True)


@pytest.mark.parametrize("kind", ["decimal(20,2)", "date", "timestamp_ntz", "timestamp", "string", "boolean", "binary", "float"])
def test_boundaries_of_every_type(spark, kind):
    make = {"date": "date_add(date'2020-01-01', cast(id as int))", "timestamp_ntz": "timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,0,id)",
            "timestamp": "timestamp'2020-01-01' + make_interval(0,0,0,0,0,id)", "boolean": "id % 2 = 0", "binary": "cast(cast(id as string) as binary)",
            "float": "if(id % 9 = 0, cast('NaN' as float), cast(id as float))"}.get(kind, f"cast(id as {kind})")
    df = spark.range(3000).selectExpr("id", f"if(id % 11 = 0, null, {make}) as k")
    got = [r[0] for r in O.with_row_index(df, ["k", "id"], n_buckets=40).orderBy("__idx").select("id").collect()]
    assert got == [r[0] for r in df.orderBy("k", "id").select("id").collect()]
