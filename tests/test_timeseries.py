"""Resample against pandas; ACF/PACF/ADF properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import timeseries as TS


@pytest.mark.parametrize("every,unit,rule,fn", [(7, "minute", "7min", "first"), (3, "hour", "3h", "mean"),
                                                 (2, "day", "2D", "max")])
def test_resample_matches_pandas(spark, events, every, unit, rule, fn):
    got = TS.resample(events.select("ts", "value"), "ts", every, unit, fn).toPandas().set_index("ts")["value"]
    pdf = events.select("ts", "value").toPandas().set_index("ts").sort_index()
    exp = getattr(pdf["value"].resample(rule), fn)()
    got = got.sort_index()
    assert list(got.index) == list(exp.index)
    assert np.allclose(got.fillna(-1).values, exp.fillna(-1).values)


def test_resample_months_matches_pandas(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderdate", "o_totalprice")
    for every in (1, 2):
        got = TS.resample(o, "o_orderdate", every, "month", "mean").toPandas().set_index("o_orderdate")
        exp = o.toPandas().set_index("o_orderdate").sort_index()["o_totalprice"].resample(f"{every}ME").mean()
        got = got.sort_index()["o_totalprice"]
        assert list(got.index) == list(exp.index)
        assert np.allclose(got.fillna(-1).values, exp.fillna(-1).values)


def _series(spark, values):
    start = pd.Timestamp("2024-01-01")
    rows = [((start + pd.Timedelta(days=i)).to_pydatetime(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t timestamp_ntz, y double")


def test_pacf_of_ar1(spark):
    rng = np.random.default_rng(5)
    y = np.zeros(3000)
    for i in range(1, len(y)):
        y[i] = 0.7 * y[i - 1] + rng.normal()
    p = {r.lag: r.pacf for r in TS.pacf(_series(spark, y), "y", "t", 5).collect()}
    assert abs(p[1] - 0.7) < 0.05
    assert all(abs(p[k]) < 0.06 for k in (2, 3, 4, 5))


def test_adf_separates_random_walk_from_noise(spark):
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.normal(size=400))
    noise = rng.normal(size=400)
    r_walk = TS.adf(_series(spark, walk), "y", "t").first()
    r_noise = TS.adf(_series(spark, noise), "y", "t").first()
    assert r_walk.p_value > 0.05 and not r_walk.stationary
    assert r_noise.p_value < 0.01 and r_noise.stationary


def _adf_by_least_squares(y, max_lag):
    """All regressors written out, one least squares fit for each lag order."""
    d = np.diff(y)

    def fit(p, start):
        rows = range(start, len(d))
        x = np.array([[1.0, y[t], *[d[t - i] for i in range(1, p + 1)]] for t in rows])
        z = d[start:]
        beta, *_ = np.linalg.lstsq(x, z, rcond=None)
        rss = ((z - x @ beta) ** 2).sum()
        n, k = x.shape
        se = np.sqrt(rss / (n - k) * np.linalg.inv(x.T @ x)[1, 1])
        return beta[1] / se, n * (np.log(2 * np.pi) + np.log(rss / n) + 1) + 2 * k, n
    best = min(range(max_lag + 1), key=lambda p: fit(p, max_lag)[1])
    t, _, n = fit(best, best)
    return t, best, n


@pytest.mark.parametrize("n,chunk", [(500, 64), (500, 7), (40, 1000), (9, 4)])
def test_adf_equals_least_squares_for_any_chunks(spark, n, chunk):
    rng = np.random.default_rng(n)
    y = 1e4 + np.cumsum(rng.normal(size=n)) + rng.normal(size=n)
    lag = max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
    got = TS.adf(_series(spark, y), "y", "t", chunk_rows=chunk).first()
    t, best, nobs = _adf_by_least_squares(y, lag)
    assert (got.used_lag, got.nobs) == (best, nobs) and abs(got.statistic - t) < 1e-6


def test_adf_over_many_rows_leaves_missing_values_out(spark):
    """60 lags over 60 000 rows: a number of sums that is linear in the lags."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=60_000)
    got = TS.adf(_series(spark, y), "y", "t").first()
    assert got.stationary and got.nobs > 59_900
    gaps = _series(spark, y[:300]).withColumn("y", F.when(F.col("y") < 1.5, F.col("y")))
    assert abs(TS.adf(gaps, "y", "t").first().statistic - _adf_by_least_squares(y[:300][y[:300] < 1.5], 16)[0]) < 1e-6


def test_mackinnon_reference_points():
    assert abs(TS.mackinnon_p(-2.8615) - 0.05) < 0.003
    assert abs(TS.mackinnon_p(-3.43) - 0.01) < 0.002


def test_forecast_ar_recovers_seasonal_pattern(spark):
    from sparkprep.ml.forecast import forecast_ar
    pattern = np.array([5, 3, 8, 1, 9, 2, 7])
    y = np.tile(pattern, 30) + np.random.default_rng(7).normal(scale=0.01, size=210)
    fc = forecast_ar(_series(spark, y), "t", "y", m=7, horizon=7, max_p=2).orderBy("step").toPandas()
    assert np.allclose(fc["forecast"].values, pattern, atol=0.2)


def _panel_frame(spark, days=60):
    """Four series over two keys, with nulls in either; values differ by series and a gap stands near one's end."""
    import datetime as dt
    rows, t0 = [], dt.datetime(2021, 1, 1)
    for s, (a, b, level) in enumerate([("a", None, 10.0), (None, "a", 500.0), ("a", "a", 2000.0), ("a|", "a", 7000.0)]):
        for i in range(days):
            v = level + [3, 1, 4, 1, 5, 9, 2][i % 7]
            rows.append((a, b, t0 + dt.timedelta(days=i), None if s == 0 and i == days - 3 else v))
    rows.append(("empty", None, t0, None))
    return spark.createDataFrame(rows, "a string, b string, t timestamp_ntz, y double")


@pytest.mark.parametrize("name,kw,tol", [("forecast_ar", dict(m=7, max_p=2, chunk_rows=25), 3.0), ("forecast_trend_seasonal", dict(yearly=0, ridge=1e-8), 2.0),
                                         ("forecast_windows", dict(length=7, max_iter=20), 400.0)])
def test_forecasts_keep_series_with_null_keys_apart(spark, name, kw, tol):
    from sparkprep.ml import forecast as FC
    fc = getattr(FC, name)(_panel_frame(spark), "t", "y", horizon=7, key=["a", "b"], **kw).toPandas()
    assert len(fc) == 4 * 7 and fc["forecast"].notna().all()
    for (a, b), level in {("a", None): 10, (None, "a"): 500, ("a", "a"): 2000, ("a|", "a"): 7000}.items():
        own = fc[(fc.a.isna() if a is None else fc.a == a) & (fc.b.isna() if b is None else fc.b == b)].sort_values("step")
        want = level + np.array([[3, 1, 4, 1, 5, 9, 2][(60 + i) % 7] for i in range(7)])
        assert list(own.step) == list(range(1, 8)) and np.abs(own.forecast.to_numpy() - want).max() < tol
        assert str(own.t.iloc[0].date()) == "2021-03-02"


def test_backtest_scores_null_keyed_series(spark):
    from sparkprep.ml import forecast as FC
    got = {r.metric: r.value for r in FC.backtest(_panel_frame(spark).where("y IS NOT NULL"), "t", "y", key=["a", "b"], m=7, max_p=2).collect()}
    assert got["R2"] == 1.0 and got["MAE"] < 1


def test_forecast_sums_equal_a_direct_fit(spark):
    """The trend model of one long series, dealt over many partitions, equals ridge least squares on the whole design."""
    from sparkprep.ml import forecast as FC
    rng = np.random.default_rng(15)
    y = np.cumsum(rng.normal(size=400)) + 5 * np.sin(np.arange(400) / 7)
    df = _series(spark, y).repartition(9)
    got = FC.forecast_trend_seasonal(df, "t", "y", horizon=5, ridge=1e-4).orderBy("step").toPandas()["forecast"].to_numpy()
    days = np.arange(405) * (df.agg((F.max("t") - F.min("t")).alias("d")).first()[0].total_seconds() / 86400 / 399)
    x = FC._trend_design(days, np.full(405, days[399]), 10, 0.8, 3, 10)
    g, c = x[:400].T @ x[:400], x[:400].T @ y
    reg = np.r_[0, np.ones(len(c) - 1)] * 1e-4 * max(1.0, np.trace(g) / len(c))
    assert np.allclose(got, x[400:] @ np.linalg.solve(g + np.diag(reg), c), rtol=1e-6, atol=1e-6)
