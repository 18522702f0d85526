"""Forecasting over one series or a keyed panel of series (F-01, F-02, F-03, F-05).

The reference fits one automatic seasonal ARIMA / Prophet / recurrent network
per request on one pandas series.  Here every series of a panel is fitted in
the same Spark jobs:

* missing values are filled forward, then backward within their series (N-12);
* ``_panel`` numbers the rows once, by (keys, time), and writes them: a series
  is known by the index of its first row, so null keys are keys like others,
  and what a series has in common (size, first and last time) reaches its rows
  by (range bucket, key).  No join or window holds a whole series;
* the design (lags, trend hinges, Fourier terms) of a batch of rows is an
  array, and its cross products are one matrix a run of rows of a series;
  matrices are added in two levels (``_grams``);
* only the tiny per-series solves and the h-step recursions see one row of
  sums, or the last few values, per series.

A series without any value has no forecast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.nulls import impute_for_model
from ..operators.timeseries import FREQ_STEP
from ..plans import ordered as O
from ..session import cut_lineage

#: Matrices of one series that are added by one task.
FAN = 1024


def _keys(key):
    return [] if key is None else ([key] if isinstance(key, str) else list(key))


def _panel(df: DataFrame, ts: str, y: str, keys: list) -> DataFrame:
    """(keys, ts, y, __sid, __pos, __n, __t0, __t1) of every row, filled, numbered and written once."""
    filled = impute_for_model(df.select(*keys, ts, F.col(y).cast("double").alias(y)), [ts], [y], keys or None)
    rows = O.series_index(filled, [ts], keys or None, name="__pos", size_name="__n", id_name="__sid", ends=(ts, "__t0", "__t1"))
    return cut_lineage(rows.where(F.col(y).isNotNull()))


def _series(panel: DataFrame, keys: list) -> DataFrame:
    """One row per series: __sid, keys, __n, __t0, __t1."""
    return panel.where("__pos = 0").select("__sid", *keys, "__n", "__t0", "__t1")


def _grams(rows: DataFrame, design) -> DataFrame:
    """(__sid, m): for each series the cross products of ``design(batch)``, an array with the target as its last column.

    ``rows`` has ``__sid``; rows that ``design`` marks with NaN are left out.  A task adds up while the series stays the same."""
    def partial(batches):
        part, slot, sid, total = TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            x = design(b)
            ids = b.column(b.schema.get_field_index("__sid")).to_numpy()
            good = ~np.isnan(x).any(axis=1)
            x, ids = x[good], ids[good]
            cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else []
            for lo, hi in zip(cut[:-1], cut[1:]):
                if ids[lo] != sid:
                    if total is not None:
                        yield one(sid, part + slot, total)
                        slot += 1
                    sid, total = ids[lo], 0.0
                total = total + x[lo:hi].T @ x[lo:hi]
        if total is not None:
            yield one(sid, part + slot, total)

    def one(sid, slot, total):
        return pa.RecordBatch.from_arrays([pa.array([sid], pa.int64()), pa.array([slot % FAN], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                          ["__sid", "slot", "m"])

    def added(t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(v.as_buffer(), dtype=np.float64) for v in t.column("m"))
        return pa.table([t.column("__sid")[:1], t.column("slot")[:1], pa.array([m.tobytes()], pa.binary())], names=["__sid", "slot", "m"])

    fields = "__sid bigint, slot int, m binary"
    parts = rows.mapInArrow(partial, fields)
    for keys in (["__sid", "slot"], ["__sid"]):
        parts = parts.groupBy(*keys).applyInArrow(added, fields)
    return parts.select("__sid", "m")


def _matrix(m: bytes) -> np.ndarray:
    flat = np.frombuffer(m, dtype=np.float64)
    return flat.reshape(math.isqrt(len(flat)), -1)


def _solve(xtx, xty, ridge=1e-8):
    k = len(xty)
    reg = np.ones(k)
    reg[0] = 0.0
    scale = max(1.0, float(np.trace(xtx)) / k)
    return np.linalg.solve(xtx + ridge * scale * np.diag(reg), xty)


def _step_expr(last_ts, step, freq: str):
    if freq in ("M", "Y"):
        months = 1 if freq == "M" else 12
        return F.last_day(F.add_months(last_ts, step * months)).cast("timestamp_ntz")
    return last_ts + F.expr(f"INTERVAL {FREQ_STEP[freq]}") * step


# ---- F-01 seasonal autoregression --------------------------------------------------------

def forecast_ar(df: DataFrame, ts: str, y: str, m: int = 0, horizon: int = 12, key=None, max_p: int = 6,
                freq: str = "D", chunk_rows: int | None = None) -> DataFrame:
    """F-01: per series AR(p) with lags 1..p (+ lag ``m`` when seasonal), p ≤
    ``max_p`` chosen by AIC on a common sample, then ``horizon`` recursive
    steps.  Output: key columns, ``step``, ``ts``, ``forecast``."""
    keys = _keys(key)
    reach = max(max_p, m)
    panel = _panel(df, ts, y, keys)
    lags = [*range(1, max_p + 1), *([m] if m > 0 else [])]

    def compute(w):
        return {"__x": F.array(*[F.lag(F.col(y), k).over(w) for k in lags], F.col(y))}

    indexed = panel.select("__sid", "__pos", y, (F.col("__sid") + F.col("__pos")).alias("__idx"))
    rows = O.halo(indexed, panel.count(), ["__sid"], reach, 0, compute, chunk_rows).where(F.col("__pos") >= reach).select("__sid", "__x")

    def design(b):
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        return np.hstack([np.ones((len(x), 1)), x])

    names = 1 + len(lags)

    def fit(pdfs):
        for pdf in pdfs:
            out = []
            for sid, own in zip(pdf["__sid"], pdf["m"]):
                g = _matrix(own)
                n, xtx, xty, yy, best = g[0, 0], g[:names, :names], g[:names, names], g[names, names], None
                for p in range(1, max_p + 1):
                    idx = [0, *range(1, p + 1), *([names - 1] if m > 0 else [])]
                    if n <= len(idx) + 1:
                        continue
                    beta = _solve(xtx[np.ix_(idx, idx)], xty[idx])
                    rss = max(yy - 2 * beta @ xty[idx] + beta @ xtx[np.ix_(idx, idx)] @ beta, 1e-12)
                    aic = n * math.log(rss / n) + 2 * len(idx)
                    if best is None or aic < best[0]:
                        coef = np.zeros(names)
                        coef[idx] = beta
                        best = (aic, coef)
                if best is None:  # too short for any lag: the mean of what there is
                    best = (0.0, np.r_[xty[0] / n, np.zeros(names - 1)])
                out.append((sid, best[1].tolist()))
            yield pd.DataFrame(out, columns=["__sid", "coef"])

    coefs = _grams(rows, design).mapInPandas(fit, "__sid bigint, coef array<double>")
    # the last `reach` values of every series (bounded per series), oldest first; a series of no more rows has no sums: its mean
    tail = panel.where(F.col("__pos") >= F.col("__n") - reach).groupBy("__sid").agg(
        F.sort_array(F.collect_list(F.struct("__pos", y))).getField(y).alias("hist"))
    job = tail.join(coefs, "__sid", "left")

    def recurse(pdfs):
        for pdf in pdfs:
            out = []
            for sid, hist, coef in zip(pdf["__sid"], pdf["hist"], pdf["coef"]):
                hist = [float(v) for v in hist]
                coef = np.r_[np.mean(hist), np.zeros(names - 1)] if coef is None else np.asarray(coef, dtype=float)
                for step in range(1, horizon + 1):
                    x = [1.0] + [hist[-k] if len(hist) >= k else 0.0 for k in lags]
                    hist.append(float(coef @ x))
                    out.append((sid, step, hist[-1]))
            yield pd.DataFrame(out, columns=["__sid", "step", "forecast"])

    fc = job.mapInPandas(recurse, "__sid bigint, step int, forecast double")
    return _label(fc, panel, keys, ts, freq)


def _label(fc: DataFrame, panel: DataFrame, keys: list, ts: str, freq: str) -> DataFrame:
    out = fc.join(_series(panel, keys), "__sid")
    return out.select(*keys, "step", _step_expr(F.col("__t1"), F.col("step"), freq).alias(ts), "forecast")


# ---- F-02 trend + Fourier seasonality -------------------------------------------------------

def _trend_design(days, total, n_changepoints, changepoint_range, weekly, yearly):
    """Columns 1, share of the span, hinges, then sines and cosines of the week and the year, for days since the first row."""
    share = days / total
    cols = [np.ones(len(days)), share]
    cols += [np.maximum(share - changepoint_range * (j + 1) / (n_changepoints + 1), 0.0) for j in range(n_changepoints)]
    for period, order in ((7.0, weekly), (365.25, yearly)):
        for k in range(1, order + 1):
            cols += [np.sin(2 * math.pi * k / period * days), np.cos(2 * math.pi * k / period * days)]
    return np.stack(cols, axis=1)


def forecast_trend_seasonal(df: DataFrame, ts: str, y: str, horizon: int = 30, key=None, freq: str = "D",
                            n_changepoints: int = 10, weekly: int = 3, yearly: int = 10,
                            changepoint_range: float = 0.8, ridge: float = 1e-3) -> DataFrame:
    """F-02: piecewise-linear trend (hinges at ``n_changepoints`` points of the
    first 80 % of each series' span) plus weekly and yearly Fourier terms,
    fitted per series by ridge least squares; forecasts ``horizon`` steps."""
    keys = _keys(key)
    panel = _panel(df, ts, y, keys)
    shape = (n_changepoints, changepoint_range, weekly, yearly)

    def days(frm, to):
        return F.timestamp_diff("SECOND", frm, to) / 86400.0

    span = F.greatest(days(F.col("__t0"), F.col("__t1")), F.lit(1e-9))
    rows = panel.select("__sid", days(F.col("__t0"), F.col(ts)).alias("d"), span.alias("total"), y)

    def design(b):
        d, total, value = (b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 3))
        return np.hstack([_trend_design(d, total, *shape), value[:, None]])

    def fit(pdfs):
        for pdf in pdfs:
            own = [_matrix(m) for m in pdf["m"]]
            yield pd.DataFrame({"__sid": pdf["__sid"], "coef": [_solve(g[:-1, :-1], g[:-1, -1], ridge).tolist() for g in own]})

    coefs = _grams(rows, design).mapInPandas(fit, "__sid bigint, coef array<double>")
    future = (_series(panel, keys).join(coefs, "__sid")
              .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))  # horizon rows per series
              .withColumn("__ft", _step_expr(F.col("__t1"), F.col("step"), freq))
              .withColumns({"__d": days(F.col("__t0"), F.col("__ft")), "__total": span}))

    @F.pandas_udf("double")
    def predicted(d: pd.Series, total: pd.Series, coef: pd.Series) -> pd.Series:
        if not len(d):
            return pd.Series([], dtype=float)
        x = _trend_design(d.to_numpy(), total.to_numpy(), *shape)
        return pd.Series((x * np.stack(coef.to_numpy())).sum(axis=1))

    return future.select(*keys, "step", F.col("__ft").alias(ts), predicted("__d", "__total", "coef").alias("forecast"))


# ---- F-03 windowed sequence model -----------------------------------------------------------

def forecast_windows(df: DataFrame, ts: str, y: str, length: int = 10, horizon: int = 12, key=None,
                     freq: str = "D", max_iter: int = 50, chunk_rows: int | None = None) -> DataFrame:
    """F-03: learn next value from the previous ``length`` values (W-15
    windows, gradient-boosted trees shared by all series), then feed the
    predictions back ``horizon`` times for every series at once."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    keys = _keys(key)
    panel = _panel(df, ts, y, keys)
    wins = W.sequence_windows(panel.select("__sid", ts, y), y, length, [ts], ["__sid"], chunk_rows)
    train = wins.select(array_to_vector("window").alias("features"), F.col("target").alias("label"))
    model = GBTRegressor(maxIter=max_iter, maxDepth=4, seed=42).fit(train)
    cur = (panel.where((F.col("__pos") >= F.col("__n") - length) & (F.col("__n") >= length)).groupBy("__sid")
           .agg(F.sort_array(F.collect_list(F.struct("__pos", y))).getField(y).alias("window")))
    outs = []
    for step in range(1, horizon + 1):
        scored = model.transform(cur.withColumn("features", array_to_vector("window")))
        scored = scored.select("__sid", "window", F.col("prediction").alias("forecast")).withColumn(
            "step", F.lit(step))
        if step % 5 == 0:
            scored = cut_lineage(scored)  # one row per series; keeps the recursion plan short
        outs.append(scored.select("__sid", "step", "forecast"))
        cur = scored.select("__sid", F.concat(F.slice("window", 2, length - 1),
                                              F.array(F.col("forecast"))).alias("window"))
    fc = outs[0]
    for o in outs[1:]:
        fc = fc.unionByName(o)
    return _label(fc, panel, keys, ts, freq)


# ---- F-05 backtest ----------------------------------------------------------------------------

def backtest(df: DataFrame, ts: str, y: str, method: str = "ar", test_size: float = 0.2, key=None,
             freq: str = "D", **kw) -> DataFrame:
    """F-05: fit on the first ``1 − test_size`` of every series, forecast the
    test length, score MAE / MSE / R² / MAPE (2 decimals) over all series."""
    from .metrics import regression_metrics

    keys = _keys(key)
    split = W.time_split(df, [ts], test_size, keys or None)
    train = split.where("split = 'train'").drop("split")
    test = split.where("split = 'test'").drop("split")
    horizon = int(test.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) if keys else test.count()
    fn = {"ar": forecast_ar, "trend": forecast_trend_seasonal, "windows": forecast_windows}[method]
    fc = fn(train, ts, y, horizon=max(horizon, 1), key=key, freq=freq, **kw)
    tpos = O.series_index(test, [ts], keys or None, name="__pos").select(*keys, y, (F.col("__pos") + 1).alias("__step"))
    fc = fc.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], "step", "forecast")
    same = F.col("__step") == F.col("step")
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    return regression_metrics(tpos.join(fc, same).select(y, "forecast"), y, "forecast", with_rmse=False)
