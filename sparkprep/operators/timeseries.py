"""Time operators (W-05 .. W-14, F-04).

Resampling is a group-by on a computed bin index plus a *distributed* spine:
``spark.range`` over the bin indices between the first and last bin (its
length is a scalar read from a one-row aggregate) left-joined with the binned
aggregate, so empty bins appear as nulls like pandas without ever building
the spine in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ordered as O
from .profile import attach_scalars
from .relational import q

UNIT_SECONDS = {"second": 1, "S": 1, "minute": 60, "T": 60, "min": 60, "hour": 3600, "H": 3600,
                "day": 86400, "D": 86400}
MONTH_UNITS = {"month": 1, "M": 1, "year": 12, "Y": 12}

# Resample aggregation modes offered by the reference.
RESAMPLE_FUNCTIONS = ("first", "last", "mean", "min", "max")


def _agg(col: str, fn: str, ts: str, order_by=()) -> Column:
    c = F.col(q(col))
    if fn == "mean":
        return F.avg(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn == "sum":
        return F.sum(c)
    if fn == "count":
        return F.count(c)
    o = F.when(c.isNotNull(), F.struct(*[F.col(q(x)) for x in (ts, *order_by)]))
    if fn == "first":
        return F.min_by(c, o)
    if fn == "last":
        return F.max_by(c, o)
    raise ValueError(f"unknown resample function {fn!r}")


def _spine(spark, bounds: DataFrame, parts: int) -> DataFrame:
    """Every bin id from the first to the last occupied bin (two scalars read)."""
    lo, hi = bounds.first()
    if lo is None:
        return spark.range(0).withColumnRenamed("id", "__bin")
    n = int(hi) - int(lo) + 1
    return spark.range(int(lo), int(hi) + 1, 1, max(1, min(parts, math.ceil(n / 100000) + 1))) \
        .withColumnRenamed("id", "__bin")


def resample(df: DataFrame, ts: str, every: int, unit: str, fn="mean", cols=None, order_by=()) -> DataFrame:
    """W-05 .. W-07: pandas ``resample(f'{every}{unit}').agg(fn)``.

    Sub-month units: bins of ``every`` units anchored at midnight of the first
    day, left-closed and labelled by their start.  Months/years: calendar
    periods labelled at the period end; a bin of ``every`` periods ends at the
    first timestamp's period and then every ``every`` periods.  Every bin from
    the first to the last is present; empty bins hold nulls (0 for count).
    ``order_by`` (a row number or key) tells rows of equal times apart for
    ``first`` and ``last``; without it the smallest and the largest of their
    values are taken, whatever the partitioning.
    """
    spark = df.sparkSession
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    fns = [fn] if isinstance(fn, str) else list(fn)
    cols = cols or [c for c in df.columns if c != ts and c not in order_by]
    t = F.col(q(ts))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if unit in MONTH_UNITS:
        if MONTH_UNITS[unit] == 12:
            period = F.year(t)
            first_period = df.agg(F.min(F.year(t)).alias("__p0"))
        else:
            period = F.year(t) * 12 + F.month(t) - 1
            first_period = df.agg(F.min(F.year(t) * 12 + F.month(t) - 1).alias("__p0"))
        step = every
        binned = attach_scalars(df, first_period).withColumn(
            "__bin", F.ceil((period - F.col("__p0")) / F.lit(step)).cast("long"))

        def label(bin_col):
            end = F.col("__p0") + bin_col * step
            if MONTH_UNITS[unit] == 12:
                return F.make_timestamp_ntz(end, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
            first_day = F.make_date((end / 12).cast("int"), (end % 12 + 1).cast("int"), F.lit(1))
            return F.last_day(first_day).cast("timestamp_ntz")
        origin = first_period
    else:
        width = every * UNIT_SECONDS[unit] * 1_000_000
        origin = df.agg(F.date_trunc("day", F.min(t)).cast("timestamp_ntz").alias("__o"))
        binned = attach_scalars(df, origin).withColumn(
            "__bin", F.floor(F.timestamp_diff("MICROSECOND", F.col("__o"), t) / F.lit(width)).cast("long"))

        def label(bin_col):
            return F.timestamp_add("MICROSECOND", bin_col * F.lit(width), F.col("__o"))
    aggs = [_agg(c, f, ts, order_by or [c]).alias(c if len(fns) == 1 else f"{c}_{f}") for c in cols for f in fns]
    grouped = binned.groupBy("__bin").agg(*aggs)
    bounds = binned.agg(F.min("__bin").alias("__lo"), F.max("__bin").alias("__hi"))
    spine = attach_scalars(_spine(spark, bounds, parts), origin)
    out = spine.join(grouped, "__bin", "left")
    fills = {}
    for c in cols:
        for f in fns:
            name = c if len(fns) == 1 else f"{c}_{f}"
            if f == "count":
                fills[name] = F.coalesce(F.col(name), F.lit(0).cast("long"))
    out = out.withColumns(fills) if fills else out
    names = [c if len(fns) == 1 else f"{c}_{f}" for c in cols for f in fns]
    return out.select(label(F.col("__bin")).alias(ts), *names)


# ---- frequency / range / axis -------------------------------------------------

def infer_frequency(df: DataFrame, ts: str) -> DataFrame:
    """W-09: sampling interval from the two earliest distinct timestamps,
    finest unit first: S, T, H, D, W, M, Y (else D)."""
    t = F.col(q(ts))
    first = df.agg(F.min(t).alias("first_ts"))
    second = attach_scalars(df, first).where(t > F.col("first_ts")).agg(F.min(t).alias("second_ts"))
    both = attach_scalars(first, second)
    secs = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("second_ts")) / 1e6
    freq = (F.when(secs <= 1, "S").when(secs <= 60, "T").when(secs <= 3600, "H").when(secs <= 86400, "D")
            .when(secs <= 7 * 86400, "W").when(secs <= 31 * 86400, "M").when(secs <= 365 * 86400, "Y")
            .otherwise("D"))
    return both.select("first_ts", "second_ts", secs.alias("seconds"), freq.alias("freq"))


def last_years(df: DataFrame, ts: str, years: int) -> DataFrame:
    """W-14: rows within ``years`` years of the latest timestamp."""
    mx = df.agg(F.max(F.col(q(ts))).alias("__max"))
    return (attach_scalars(df, mx)
            .where(F.col(q(ts)) >= (F.col("__max") - F.make_ym_interval(F.lit(years))).cast(df.schema[ts].dataType))
            .drop("__max"))


FREQ_STEP = {"S": "1 second", "T": "1 minute", "H": "1 hour", "D": "1 day", "W": "7 days"}


def future_axis(df: DataFrame, ts: str, horizon: int, freq: str = "D") -> DataFrame:
    """F-04: the next ``horizon`` timestamps after the last one, at ``freq``
    (S/T/H/D/W fixed steps, M/Y calendar month/year ends)."""
    spark = df.sparkSession
    mx = df.agg(F.max(F.col(q(ts))).alias("__max"))
    steps = spark.range(1, horizon + 1).withColumnRenamed("id", "step")
    j = attach_scalars(steps, mx)
    if freq == "M":
        nxt = F.last_day(F.add_months(F.col("__max"), F.col("step").cast("int"))).cast("timestamp_ntz")
    elif freq == "Y":
        nxt = F.make_date(F.year("__max") + F.col("step").cast("int"), F.lit(12), F.lit(31)).cast("timestamp_ntz")
    else:
        nxt = F.col("__max") + F.expr(f"INTERVAL {FREQ_STEP[freq]}") * F.col("step")
    return j.select("step", nxt.alias(ts))


# ---- decomposition, autocorrelation, stationarity --------------------------------

def decompose(df: DataFrame, col: str, order_by, period: int = 12, model: str = "additive",
              chunk_rows: int | None = None) -> DataFrame:
    """W-10: classical decomposition (centred moving-average trend, per-phase
    mean seasonal normalised to mean 0 / 1, residual).  Output: order columns,
    ``observed``, ``trend``, ``seasonal``, ``resid``."""
    mult = model.startswith("mult")
    h = period // 2
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    y = F.col(q(col)).cast("double")

    def compute(w):
        frame = w.rowsBetween(-h, h)
        full = F.count(F.lit(1)).over(frame) == 2 * h + 1
        if period % 2 == 0:
            s = F.sum(y).over(frame) - 0.5 * F.lag(y, h).over(w) - 0.5 * F.lead(y, h).over(w)
        else:
            s = F.sum(y).over(frame)
        return {"trend": F.when(full, s / period)}

    tr = O.halo_window(df.select(*order, y.alias(col)), order, None, h, h, compute, chunk_rows)
    tr = tr.withColumn("__phase", F.col("__idx") % period)
    det = (y / F.col("trend")) if mult else (y - F.col("trend"))
    phase = tr.groupBy("__phase").agg(F.avg(det).alias("__pm"))  # `period` rows
    norm = phase.agg(F.avg("__pm").alias("__pmm"))
    phase = attach_scalars(phase, norm).select(
        "__phase", ((F.col("__pm") / F.col("__pmm")) if mult else (F.col("__pm") - F.col("__pmm"))).alias("seasonal"))
    out = tr.join(F.broadcast(phase), "__phase")
    resid = (y / (F.col("trend") * F.col("seasonal"))) if mult else (y - F.col("trend") - F.col("seasonal"))
    return out.select(*order, y.alias("observed"), "trend", "seasonal", resid.alias("resid"))


def _lagged(df: DataFrame, col: str, order_by, lags: int, chunk_rows=None) -> DataFrame:
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    y = F.col(q(col)).cast("double")
    return O.halo_window(df.select(*order, y.alias("__y")), order, None, lags, 0,
                         lambda w: {f"__l{k}": F.lag(F.col("__y"), k).over(w) for k in range(1, lags + 1)},
                         chunk_rows)


def acf(df: DataFrame, col: str, order_by, lags: int = 20, chunk_rows: int | None = None) -> DataFrame:
    """W-11: autocorrelation r_k = Σ (y_t − ȳ)(y_{t−k} − ȳ) / Σ (y_t − ȳ)², k = 0..lags (null for a constant series)."""
    lagged = _lagged(df, col, order_by, lags, chunk_rows)
    mean = lagged.agg(F.avg("__y").alias("__mu"))
    j = attach_scalars(lagged, mean)
    d = F.col("__y") - F.col("__mu")
    sums = [F.sum(d * d).alias("__c0")] + [
        F.sum(d * (F.col(f"__l{k}") - F.col("__mu"))).alias(f"__c{k}") for k in range(1, lags + 1)]
    one = j.agg(*sums)
    rows = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"__c{k}"), F.col("__c0")).alias("acf"))
            for k in range(0, lags + 1)]
    return one.select(F.inline(F.array(*rows)))


def levinson_durbin(r):
    """PACF from autocorrelations r[0..L] (Yule–Walker, Levinson recursion)."""
    L = len(r) - 1
    pacf = [1.0]
    phi_prev = []
    v = r[0]
    for k in range(1, L + 1):
        acc = r[k] - sum(phi_prev[j] * r[k - 1 - j] for j in range(len(phi_prev)))
        a = acc / v if v else float("nan")
        phi = [phi_prev[j] - a * phi_prev[k - 2 - j] for j in range(len(phi_prev))] + [a]
        v = v * (1 - a * a)
        pacf.append(a)
        phi_prev = phi
    return pacf


def pacf(df: DataFrame, col: str, order_by, lags: int = 20, chunk_rows: int | None = None) -> DataFrame:
    """W-12: partial autocorrelation by Yule–Walker (no small-sample adjustment).

    The autocorrelations come from the Spark ``acf`` aggregate (lags+1
    numbers); the Levinson recursion over those few numbers runs on the driver.
    """
    r = [row["acf"] for row in acf(df, col, order_by, lags, chunk_rows).orderBy("lag").collect()]
    values = levinson_durbin(r)
    spark = df.sparkSession
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "lag int, pacf double")


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def mackinnon_p(t: float) -> float:
    """Approximate p-value of the ADF t statistic with a constant (MacKinnon 1994)."""
    # MacKinnon (1994) response-surface coefficients, constant-only case.
    tau_max, tau_min, tau_star = 2.74, -18.83, -1.61
    small = (2.1659, 1.4412, 0.038269)
    large = (1.7339, 0.93202, -0.12745, -0.010368)
    if t > tau_max:
        return 1.0
    if t < tau_min:
        return 0.0
    if t <= tau_star:
        return _norm_cdf(small[0] + small[1] * t + small[2] * t * t)
    return _norm_cdf(large[0] + large[1] * t + large[2] * t * t + large[3] * t ** 3)


CHUNK_ROWS = 1 << 17


def _lag_sums(indexed: DataFrame, lags: int, chunk_rows: int) -> tuple:
    """(P, Q) of a series (``__idx``, ``__y``) with differences d: P[k] = Σ d_s d_{s−k} for k = 0..lags and
    Q[k] = Σ y_{s−1} d_{s−k}, summed over every s whose terms exist.

    A chunk of consecutive rows, with ``lags + 1`` rows before it, is one task's array work; 2 (lags + 1) sums leave it."""
    import numpy as np
    import pyarrow as pa

    reach = lags + 1
    first, last = F.floor(F.col("__idx") / chunk_rows), F.floor((F.col("__idx") + reach) / chunk_rows)
    chunks = indexed.withColumn("__chunk", F.explode(F.sequence(first, last)))

    def sums(key, table):
        table = table.sort_by("__idx")
        idx, y = table.column("__idx").to_numpy(), table.column("__y").to_numpy()
        at = int(np.searchsorted(idx, key[0].as_py() * chunk_rows))  # rows of the chunk itself start here
        d = np.concatenate([[0.0], np.diff(y)])                      # the first row has no difference: a term of 0
        out = np.zeros((2, lags + 1))
        before = np.concatenate([[0.0], y[:-1]])
        for k in range(lags + 1):
            s = max(at, k + 1)                                       # s - k >= 1 within the rows at hand
            if s < len(y):
                out[0, k] = d[s:] @ d[s - k:len(y) - k]
                out[1, k] = before[s:] @ d[s - k:len(y) - k]
        return pa.table([pa.array([out[0].tolist()]), pa.array([out[1].tolist()])], names=["p", "q"])

    parts = chunks.groupBy("__chunk").applyInArrow(sums, "p array<double>, q array<double>")
    rows = (parts.select(F.posexplode(F.arrays_zip("p", "q")).alias("k", "v")).groupBy("k")
            .agg(F.sum("v.p"), F.sum("v.q")).collect())
    got = {r[0]: (r[1], r[2]) for r in rows}
    return tuple(np.array([got[k][j] for k in range(lags + 1)]) for j in (0, 1))


def adf(df: DataFrame, col: str, order_by, max_lag: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """W-13: augmented Dickey–Fuller test with a constant, lag order by AIC.

    Regression Δy_t = a + b·y_{t−1} + Σ c_i Δy_{t−i}.  Its cross products depend
    on the distance of two lags only, but for products at the ends of the
    series.  So Spark sums one product per lag (``_lag_sums``), the driver takes
    the first and last ``max_lag + 2`` values, and corrects the sums for any lag
    order and sample.  One Cholesky factor gives the residuals of all orders.
    Returns one row: statistic, p-value, used lag, n, stationary (p < 0.05).

    Missing values are left out.  The series is centred first, which changes
    neither b nor its error.
    """
    import numpy as np

    from ..session import cut_lineage

    order = [order_by] if isinstance(order_by, str) else list(order_by)
    raw = F.col(q(col)).cast("double")
    there = df.where(raw.isNotNull() & ~F.isnan(raw)).select(*order, raw.alias("__raw"))
    n, mean = there.agg(F.count(F.lit(1)), F.avg("__raw")).first()
    if max_lag is None:
        max_lag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    max_lag = max(0, min(max_lag, n // 2 - 2))
    centred = there.select(*order, (F.col("__raw") - F.lit(mean or 0.0)).alias("__y"))
    indexed = cut_lineage(O.with_row_index(centred, order).select("__idx", "__y"))
    P, Q = _lag_sums(indexed, max_lag, chunk_rows or CHUNK_ROWS)
    sum_y, sum_yy = indexed.agg(F.sum("__y"), F.sum(F.col("__y") * F.col("__y"))).first()
    reach = max_lag + 2
    ends = dict(indexed.where((F.col("__idx") < reach) | (F.col("__idx") >= n - reach)).select("__idx", "__y").collect())
    y = np.zeros(n if n <= 2 * reach else 2 * reach)  # the first and last values; place(t) finds value t
    for t, v in ends.items():
        y[t if t < reach else t - n + len(y)] = v

    def place(t):
        return t if t < reach else t - n + len(y)

    def value(t):
        return y[place(t)]

    def diff(t):
        return y[place(t)] - y[place(t) - 1]

    head, tail = range(1, reach), range(max(reach, n - reach + 1), n)
    d = {t: diff(t) for t in (*head, *tail)}

    def moments(p):
        """Cross products of (d_t, 1, y_{t−1}, d_{t−1}, ..., d_{t−p}) over t = p + 1 .. n − 1."""
        size, start = p + 3, p + 1
        m = np.zeros((size, size))
        col_of = lambda i: 0 if i == 0 else i + 2
        for k in range(p + 1):
            early = np.cumsum([0.0] + [d[s] * d[s - k] for s in range(k + 1, start)])           # products of s = k + 1, k + 2, ...
            late = np.cumsum([0.0] + [d[s] * d[s - k] for s in range(n - 1, n - 1 - (p - k), -1)])  # of s = n − 1, n − 2, ...
            for i in range(p + 1 - k):
                a, b = col_of(i), col_of(i + k)
                m[a, b] = m[b, a] = P[k] - early[start - i - k - 1] - late[i]
            # y_{s−1} d_{s−k}, s = start .. n − 1
            b = col_of(k)
            m[2, b] = m[b, 2] = Q[k] - sum(value(s - 1) * d[s - k] for s in range(k + 1, start))
            m[1, b] = m[b, 1] = value(n - 1 - k) - value(start - k - 1)
        m[1, 1] = n - start
        m[1, 2] = m[2, 1] = sum_y - value(n - 1) - sum(value(s) for s in range(start - 1))
        m[2, 2] = sum_yy - value(n - 1) ** 2 - sum(value(s) ** 2 for s in range(start - 1))
        return n - start, m

    # all orders on the sample of the largest: the residuals fall by one squared term a regressor
    nobs, m = moments(max_lag)
    terms = np.linalg.solve(np.linalg.cholesky(m[1:, 1:]), m[1:, 0])
    rss = m[0, 0] - np.cumsum(terms ** 2)[1:]
    aic = [nobs * (math.log(2 * math.pi) + math.log(r / nobs) + 1) + 2 * (p + 2) for p, r in enumerate(rss)]
    best = int(np.argmin(aic))
    nobs, m = moments(best)
    beta = np.linalg.solve(m[1:, 1:], m[1:, 0])
    sigma2 = (m[0, 0] - beta @ m[1:, 0]) / (nobs - best - 2)
    t = float(beta[1] / math.sqrt(sigma2 * np.linalg.inv(m[1:, 1:])[1, 1]))
    p = mackinnon_p(t)
    return df.sparkSession.createDataFrame([(t, p, best, int(nobs), p < 0.05)],
                                           "statistic double, p_value double, used_lag int, nobs long, stationary boolean")
