"""Time series by group: zero-filled spines, trends, tests, expanding-window validation, forecasts and their measures.

A series is (key, ds, y), with idx from 0 in order of date. Windows are within a series; a fold is joined to the series by
index, so validation is declarative but for models that must be fitted, which run once per series and fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.stats import t_p_value


def spine(df: DataFrame, key: str, ds: str, y: str, step: str = "1 day") -> DataFrame:
    """``df`` with a row for every key and date between the first and last of all, y 0 where it had none."""
    ends = df.agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    every = df.select(key).distinct().crossJoin(F.broadcast(ends)).select(key, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias("_d")).select(key, F.col("_d").cast("date").alias(ds))
    return every.join(df, [key, ds], "left").select(key, ds, F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias(y))


def indexed(series: DataFrame, key: str = "key", ds: str = "ds") -> DataFrame:
    return series.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(ds)) - 1)


def trend(series: DataFrame, unit: str = "days") -> DataFrame:
    """Least squares by key: slope, r squared, n, and the t statistic of the slope. ``unit``: x in days or weeks."""
    first = F.min("ds").over(Window.partitionBy())  # the first date of all; one small row per date and key
    x = F.datediff("ds", first) / (7.0 if unit == "weeks" else 1.0)
    fit = series.withColumn("x", x).groupBy("key").agg(F.sum("y").alias("total"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(1 - F.col("r2"), F.lit(0.0))) * F.signum("slope")
    return fit.withColumn("t", t)


def trend_labels(series: DataFrame, unit: str = "days", steep: float = 0.05, level: float = 0.05) -> DataFrame:
    f = trend(series, unit).withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 2))
    sure = F.col("p_value") < level
    label = F.when((F.col("slope") > steep) & sure, "growing ↑").when((F.col("slope") < -steep) & sure, "declining ↓").otherwise("stable →")
    return f.select("key", "total", F.round("slope", 3).alias("slope_per_week"), F.round("r2", 3).alias("r_squared"), F.round("p_value", 4).alias("p_value"), label.alias("trend"))


def decompose(series: DataFrame, period: int = 4) -> DataFrame:
    """Additive decomposition: centred moving mean, mean deviation by season about its own mean, rest."""
    s = indexed(series)
    w = Window.partitionBy("key").orderBy("idx")
    half = period // 2
    whole = w.rowsBetween(-half, half)
    if period % 2:
        level = F.avg("y").over(whole)
    else:
        level = (F.sum("y").over(whole) - (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2) / period
    s = s.withColumn("trend", F.when(F.count("*").over(whole) == 2 * half + 1, level)).withColumn("season", F.col("idx") % period)
    raw = F.avg(F.col("y") - F.col("trend")).over(Window.partitionBy("key", "season"))
    s = s.withColumn("raw", raw)
    means = s.select("key", "season", "raw").distinct().groupBy("key").agg(F.avg("raw").alias("m"))
    s = s.join(means, "key").withColumn("seasonal", F.col("raw") - F.col("m"))
    return s.select("key", "ds", "y", F.round("trend", 6).alias("trend"), F.round("seasonal", 6).alias("seasonal"), F.round(F.col("y") - F.col("trend") - F.col("seasonal"), 6).alias("resid"))


def autocorrelation(series: DataFrame, lags: int = 4) -> DataFrame:
    """(key, lag, acf, q): autocorrelations, and the Ljung-Box statistic up to each lag."""
    s = indexed(series)
    m = s.withColumns({"n": F.count("*").over(Window.partitionBy("key")), "d": F.col("y") - F.avg("y").over(Window.partitionBy("key"))})
    w = Window.partitionBy("key").orderBy("idx")
    products = [F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)]
    lagged = m.withColumns({f"d{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)})
    sums = lagged.groupBy("key").agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), *products)
    long = sums.select("key", "n", F.posexplode(F.array(*[F.col(f"c{k}") / F.nullif(F.col("c0"), F.lit(0.0)) for k in range(1, lags + 1)])).alias("lag", "acf")).withColumn("lag", F.col("lag") + 1)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(Window.partitionBy("key").orderBy("lag"))
    return long.select("key", F.col("lag").cast("long").alias("lag"), F.round("acf", 6).alias("acf"), F.round(q, 4).alias("q"))


def partial_autocorrelation(series: DataFrame, lags: int = 4) -> DataFrame:
    """(key, lag, pacf) by the recursion of Durbin and Levinson over the autocorrelations: one row a key, few lags."""
    by_lag = autocorrelation(series, lags).groupBy("key").agg(*[F.max(F.when(F.col("lag") == k, F.col("acf"))).alias(f"r{k}") for k in range(1, lags + 1)])
    r = lambda k: F.col(f"r{k}")
    out = by_lag.withColumn("p1_1", r(1))
    for k in range(2, lags + 1):
        over = r(k) - sum(F.col(f"p{k - 1}_{j}") * r(k - j) for j in range(1, k))
        under = F.lit(1.0) - sum(F.col(f"p{k - 1}_{j}") * r(j) for j in range(1, k))
        out = out.withColumn(f"p{k}_{k}", over / F.nullif(under, F.lit(0.0)))
        out = out.withColumns({f"p{k}_{j}": F.col(f"p{k - 1}_{j}") - F.col(f"p{k}_{k}") * F.col(f"p{k - 1}_{k - j}") for j in range(1, k)})
    return out.select("key", F.posexplode(F.array(*[F.round(f"p{k}_{k}", 4) for k in range(1, lags + 1)])).alias("lag", "pacf")).withColumn("lag", (F.col("lag") + 1).cast("long"))


def jarque_bera(series: DataFrame) -> DataFrame:
    """(key, jb): n / 6 * (skewness^2 + (kurtosis - 3)^2 / 4)."""
    c = series.withColumn("d", F.col("y") - F.avg("y").over(Window.partitionBy("key")))
    m = lambda k: F.avg(F.pow("d", F.lit(k)))
    g = c.groupBy("key").agg(F.count("*").alias("n"), m(2).alias("m2"), m(3).alias("m3"), m(4).alias("m4"))
    s2, k = F.col("m3") * F.col("m3") / F.pow("m2", F.lit(3)), F.col("m4") / F.pow("m2", F.lit(2)) - 3
    return g.select("key", F.round(F.col("n") / 6 * (s2 + k * k / 4), 4).alias("jb"))


def adf(series: DataFrame, lags: int = 1) -> DataFrame:
    """(key, adf): the t statistic of y(t-1) in the regression of its change on it, ``lags`` changes and a constant."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ds").y.to_numpy(float)
        d = np.diff(y)
        n = len(d) - lags
        if n <= lags + 2:
            return pd.DataFrame({"key": [pdf.key.iloc[0]], "adf": [np.nan]})
        x = np.column_stack([y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)], np.ones(n)])
        b, *_ = np.linalg.lstsq(x, d[lags:], rcond=None)
        e = d[lags:] - x @ b
        var = e @ e / max(1, n - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0]
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "adf": [round(float(b[0] / np.sqrt(var)), 4) if var > 0 else np.nan]})

    return series.groupBy("key").applyInPandas(fit, f"key {series.schema['key'].dataType.simpleString()}, adf double")


def arch_lm(series: DataFrame, lags: int = 4) -> DataFrame:
    """(key, lm): n R^2 of squared deviations regressed on their own lags."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ds").y.to_numpy(float)
        e = (y - y.mean()) ** 2
        n = len(e) - lags
        lm = np.nan
        if n > lags + 1:
            x = np.column_stack([*[e[lags - k : len(e) - k] for k in range(1, lags + 1)], np.ones(n)])
            t = e[lags:]
            b, *_ = np.linalg.lstsq(x, t, rcond=None)
            total = ((t - t.mean()) ** 2).sum()
            lm = round(float(n * (1 - ((t - x @ b) ** 2).sum() / total)), 4) if total > 0 else np.nan
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "lm": [lm]})

    return series.groupBy("key").applyInPandas(fit, f"key {series.schema['key'].dataType.simpleString()}, lm double")


def folds(series: DataFrame, least: int, horizon: int, stride: int) -> DataFrame:
    """(key, split): training is idx < split, the test the ``horizon`` points from split on."""
    sizes = indexed(series).groupBy("key").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= least + horizon)
    return sizes.select("key", F.explode(F.sequence(F.lit(least), F.col("n") - horizon, F.lit(stride))).alias("split")).select("key", F.col("split").cast("long").alias("split"))


def naive_forecasts(series: DataFrame, least: int, horizon: int = 1, stride: int = 1) -> DataFrame:
    """(key, split, idx, y, naive, ma4, drift, scale): forecasts from the last value, the mean of the last four, and the line
    through first and last; ``scale`` is the mean change over seven steps in training."""
    s = indexed(series)
    w = Window.partitionBy("key").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    change = F.abs(F.col("y") - F.lag("y", 7).over(w))
    known = s.withColumn("change", change).select("key", (F.col("idx") + 1).cast("long").alias("split"), F.col("y").alias("naive"), F.avg("y").over(w.rowsBetween(-3, 0)).alias("ma4"), F.first("y").over(upto).alias("y0"), F.avg("change").over(upto).alias("scale"))
    f = folds(series, least, horizon, stride).join(known, ["key", "split"])
    test = f.withColumn("idx", F.explode(F.sequence(F.col("split"), F.col("split") + horizon - 1))).join(s.select("key", "idx", "y"), ["key", "idx"])
    ahead = F.col("idx") - F.col("split") + 1
    slope = (F.col("naive") - F.col("y0")) / F.nullif(F.col("split") - 1, F.lit(0))
    return test.select("key", "split", "idx", "y", "naive", "ma4", (F.col("naive") + ahead * F.coalesce(slope, F.lit(0.0))).alias("drift"), "scale")


def measures(forecasts: DataFrame, by: list[str], model: str) -> DataFrame:
    """MAE, RMSE, sMAPE, MAPE over non-zero actuals, MASE and R squared of a column of forecasts."""
    y, p = F.col("y"), F.col(model)
    e = F.abs(y - p)
    smape = 100 * F.avg(2 * e / (F.abs(y) + F.abs(p) + 1e-8))
    ss = F.var_pop("y") * F.count("*")
    r = lambda x: F.round(x, 6)
    return forecasts.groupBy(*by).agg(
        F.count("*").alias("n"), r(F.avg(e)).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(smape).alias("smape"), r(100 * F.avg(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0)))))).alias("mape"),
        r(F.avg(e / F.nullif(F.col("scale"), F.lit(0.0)))).alias("mase"), r(1 - F.sum(e * e) / F.nullif(ss, F.lit(0.0))).alias("r2"),
    )


def diebold_mariano(forecasts: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Statistic of the difference of squared errors; null for fewer than three or equal differences."""
    d = F.pow(F.col("y") - F.col(a), F.lit(2)) - F.pow(F.col("y") - F.col(b), F.lit(2))
    g = forecasts.withColumn("d", d).groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.var_samp("d").alias("v"))
    ok = (F.col("n") >= 3) & (F.col("v") >= 1e-10)
    return g.select(*by, "n", F.when(ok, F.round(F.col("m") / F.sqrt(F.col("v") / F.col("n")), 3)).alias("dm"))


def with_dm_p(dm: DataFrame) -> DataFrame:
    return dm.withColumn("p_value", F.round(t_p_value(F.abs("dm"), F.col("n") - 1), 4))


def weighted_mae(table: DataFrame, mae: str, weight: str) -> Column:
    known = F.when(F.col(mae).isNotNull(), F.col(weight))
    return F.sum(F.col(mae) * known) / F.nullif(F.sum(known), F.lit(0.0))


def best_model(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """(key, best, mae): the model of least mean absolute error of each series; ties go to the first named."""
    maes = forecasts.groupBy("key").agg(*[F.round(F.avg(F.abs(F.col("y") - F.col(m))), 6).alias(m) for m in models])
    entry = F.array_min(F.array(*[F.struct(F.col(m).alias("mae"), F.lit(i).alias("i"), F.lit(m).alias("model")) for i, m in enumerate(models)]))
    return maes.select("key", entry["model"].alias("best"), entry["mae"].alias("mae"))


def interval_scores(df: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Coverage and Winkler score of (lo, hi) about y, and QLIKE of ``var`` for y squared."""
    y, lo, hi, v = (F.col(c) for c in ("y", "lo", "hi", "var"))
    miss = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
    return df.groupBy(*by).agg(F.round(F.avg(y.between(lo, hi).cast("double")), 6).alias("coverage"), F.round(F.avg(hi - lo + (2 / alpha) * miss), 4).alias("winkler"), F.round(F.avg(F.ln(v + 1e-8) + y * y / (v + 1e-8)), 6).alias("qlike"))


def holt_winters(y: np.ndarray, horizon: int, season: int = 0, damped: bool = False) -> np.ndarray:
    """Additive exponential smoothing with trend, and season if > 1; parameters from a grid by squared one-step error.

    Starts from the first two seasons' means; a series too short for them has no season. Forecasts are not below 0.
    """
    y = np.asarray(y, float)
    if len(y) < max(3, 2 * season):
        season = 0
    if len(y) < 3:
        return np.full(horizon, max(0.0, float(y[-1]) if len(y) else 0.0))
    phi = 0.9 if damped else 1.0
    grid = (0.1, 0.3, 0.6, 0.9)
    best = None
    for alpha in grid:
        for beta in (0.01, 0.1, 0.3):
            for gamma in (0.05, 0.2, 0.5) if season else (0.0,):
                if season:
                    level, slope = y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season
                    s = list(y[:season] - level)
                else:
                    level, slope, s = y[0], y[1] - y[0], [0.0]
                sse = 0.0
                for t, v in enumerate(y):
                    k = t % len(s)
                    guess = level + phi * slope + s[k]
                    sse += (v - guess) ** 2
                    new = alpha * (v - s[k]) + (1 - alpha) * (level + phi * slope)
                    slope = beta * (new - level) + (1 - beta) * phi * slope
                    if season:
                        s[k] = gamma * (v - new) + (1 - gamma) * s[k]
                    level = new
                if best is None or sse < best[0]:
                    best = (sse, level, slope, s)
    _, level, slope, s = best
    steps = np.arange(1, horizon + 1)
    run = np.cumsum(phi**steps) if damped else steps
    return np.maximum(0, level + run * slope + np.array([s[(len(y) + h - 1) % len(s)] for h in steps]))


def trend_weekday(y: np.ndarray, horizon: int, season: int = 7) -> np.ndarray:
    """A line and a level for each day of the season by least squares: a stand-in where no outside forecaster is at hand."""
    t = np.arange(len(y) + horizon)
    x = np.column_stack([t, *[(t % season == k).astype(float) for k in range(season)]])
    b, *_ = np.linalg.lstsq(x[: len(y)], np.asarray(y, float), rcond=None)
    return np.maximum(0, x[len(y) :] @ b)


def fitted_forecasts(series: DataFrame, least: int, horizon: int, stride: int, season: int = 7) -> DataFrame:
    """(key, split, idx, y, ets, damped, line, ensemble): fitted models by fold, the ensemble being the mean of damped and naive."""
    kind = series.schema["key"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y, out = pdf.y.to_numpy(float), []
        for split in range(least, len(y) - horizon + 1, stride):
            train = y[:split]
            ets, damped, line = holt_winters(train, horizon, season), holt_winters(train, horizon, 0, True), trend_weekday(train, horizon, season)
            out.append(pd.DataFrame({"key": pdf.key.iloc[0], "split": split, "idx": np.arange(split, split + horizon), "y": y[split : split + horizon], "ets": ets, "damped": damped, "line": line, "ensemble": (damped + train[-1]) / 2}))
        columns = ["key", "split", "idx", "y", "ets", "damped", "line", "ensemble"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return series.select("key", "ds", "y").groupBy("key").applyInPandas(fit, f"key {kind}, split int, idx int, y double, ets double, damped double, line double, ensemble double")
