"""Models fitted by likelihood to series and folds of series: ARIMA, GARCH, and a trend with changepoints.

A row is one fit: a fold has the series as an array and how much of it is training, and rows are dealt over all tasks, whatever
series they are of. A task fits its rows together: parameters of all rows move at once (``minimise``), and a likelihood runs
once through time for all rows and all steps of their gradients. A row's arrays are as long as its series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.series import folds, indexed

#: Rows that are fitted together.
TOGETHER = 64


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 80, step: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Least values of a function of each row's parameters, by BFGS for all rows at once: (parameters, values).

    ``f(theta, row)`` gives the values of parameters ``theta`` of the rows numbered ``row``; central differences are the gradients.
    """
    n, k = start.shape
    x, rows = start.astype(float).copy(), np.arange(n)
    if not k:
        return x, f(x, rows)

    def slope(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        shift = np.concatenate([np.eye(k), -np.eye(k)]) * step
        v = f((at[:, None] + shift[None]).reshape(-1, k), np.repeat(row, 2 * k)).reshape(-1, 2 * k)
        return np.nan_to_num((v[:, :k] - v[:, k:]) / (2 * step), nan=0.0, posinf=0.0, neginf=0.0)

    inverse, value, g = np.tile(np.eye(k), (n, 1, 1)), f(x, rows), slope(x, rows)
    live = np.ones(n, bool)
    for _ in range(rounds):
        at = np.flatnonzero(live)
        if not len(at):
            break
        move = -np.einsum("nij,nj->ni", inverse[at], g[at])
        up = (move * g[at]).sum(1) >= 0
        inverse[at[up]], move[up] = np.eye(k), -g[at[up]]
        size = np.minimum(1.0, 2.0 / np.maximum(np.abs(move).max(1), 1e-12))
        best, found = value[at].copy(), np.zeros(len(at), bool)
        new = x[at].copy()
        for _ in range(25):
            left = np.flatnonzero(~found)
            if not len(left):
                break
            tried = x[at[left]] + size[left, None] * move[left]
            v = f(tried, at[left])
            ok = v < value[at[left]] + 1e-4 * size[left] * (move[left] * g[at[left]]).sum(1)
            new[left[ok]], best[left[ok]], found[left[ok]] = tried[ok], v[ok], True
            size[left[~ok]] /= 2
        live[at[~found]] = False
        at, new, best = at[found], new[found], best[found]
        if not len(at):
            break
        after = slope(new, at)
        s, y = new - x[at], after - g[at]
        sy = (s * y).sum(1)
        good = sy > 1e-12
        r = 1 / np.where(good, sy, 1.0)
        left_side = np.eye(k)[None] - r[:, None, None] * s[:, :, None] * y[:, None, :]
        updated = np.einsum("nij,njk,nlk->nil", left_side, inverse[at], left_side) + r[:, None, None] * s[:, :, None] * s[:, None, :]
        inverse[at] = np.where(good[:, None, None], updated, inverse[at])
        live[at] = (value[at] - best > 1e-9 * (1 + np.abs(best))) & (np.abs(after).max(1) > 1e-6)
        x[at], value[at], g[at] = new, best, after
    return x, value


# --- ARIMA ------------------------------------------------------------------------------------------------------------
def stable(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from partial autocorrelations, given as any reals by row."""
    p = np.tanh(partial)
    out = np.zeros_like(p)
    for k in range(p.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - p[:, k : k + 1] * before[:, ::-1]
        out[:, k] = p[:, k]
    return out


def _filter(z: np.ndarray, known: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean log innovation variance, mean squared scaled innovation, state after the last value) of ARMA by row, exactly: the
    state starts at its stationary variance. ``known`` marks each row's values; they are at its beginning."""
    n, p, q = len(z), ar.shape[1], ma.shape[1]
    r = max(p, q + 1)
    phi, load = np.zeros((n, r)), np.zeros((n, r))
    phi[:, :p], load[:, 0], load[:, 1 : q + 1] = ar, 1.0, ma
    t = np.zeros((n, r, r))
    t[:, :, 0] = phi
    t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    noise = load[:, :, None] * load[:, None, :]
    var, power = noise.copy(), t.copy()
    for _ in range(12):  # the sum of a doubling series: 4096 steps of the past
        var = var + power @ var @ power.transpose(0, 2, 1)
        power = power @ power
        power = np.clip(power, -1e6, 1e6)
    a = np.zeros((n, r))
    logs, squares, count = np.zeros(n), np.zeros(n), known.sum(1)
    for i in range(z.shape[1]):
        on = known[:, i]
        f = np.maximum(var[:, 0, 0], 1e-12)
        v = z[:, i] - a[:, 0]
        logs += np.where(on, np.log(f), 0)
        squares += np.where(on, v * v / f, 0)
        gain = var[:, :, 0] / f[:, None]
        a2 = np.einsum("nij,nj->ni", t, a + gain * v[:, None])
        inner = var - gain[:, :, None] * var[:, None, 0, :]
        var2 = t @ inner @ t.transpose(0, 2, 1) + noise
        a = np.where(on[:, None], a2, a)
        var = np.where(on[:, None, None], var2, var)
    return logs / np.maximum(count, 1), squares / np.maximum(count, 1), a


def differences(y: np.ndarray, most: int = 2, critical: float = 0.463) -> int:
    """How often to difference: until the level test of stationarity (Kwiatkowski and others, at 5 %) doesn't reject."""
    for d in range(most):
        e = y - y.mean()
        n = len(e)
        lags = int(np.sqrt(n))
        long_run = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
        if n < 8 or long_run <= 0 or (np.cumsum(e) ** 2).sum() / n**2 / long_run <= critical:
            return d
        y = np.diff(y)
    return most


def _differenced(series: list[np.ndarray], d: list[int]) -> tuple[np.ndarray, np.ndarray]:
    cut = [np.diff(s, k) for s, k in zip(series, d, strict=True)]
    z = np.zeros((len(cut), max(map(len, cut))))
    known = np.zeros(z.shape, bool)
    for i, c in enumerate(cut):
        z[i, : len(c)], known[i, : len(c)] = c, True
    return z, known


def fit_arima(series: list[np.ndarray], most_p: int = 3, most_q: int = 3, extra: list[np.ndarray] | None = None, d: int | None = None, orders: list[tuple[int, int]] | None = None) -> list[dict]:
    """For each series the ARIMA of least AICc over ``orders`` (p, q), or all up to the most: p, d, q, ar, ma, mean (of the differences), sigma2, aicc, effect.

    ``extra``: a regressor beside each series; its effect is estimated with the rest.
    """
    many = [differences(s) if d is None else d for s in series]
    z, known = _differenced(series, many)
    x = _differenced(extra, many)[0] if extra is not None else None
    count = known.sum(1)
    scale = np.array([max(np.std(row[k]), 1e-9) for row, k in zip(z, known, strict=True)])
    z = z / scale[:, None]
    with_mean = np.array([k < 2 for k in many])
    mean0 = (z * known).sum(1) / count
    out: list[dict | None] = [None] * len(series)
    extras = int(x is not None)
    for p, q in orders or [(p, q) for p in range(most_p + 1) for q in range(most_q + 1)]:

        def parts(theta, row, p=p, q=q):
            ar, ma = stable(theta[:, :p]), -stable(theta[:, p : p + q])
            w = z[row] - np.where(with_mean[row], theta[:, p + q], 0)[:, None]
            return ar, ma, (w - theta[:, -1:] * x[row] if extras else w) * known[row]

        def loss(theta, row, parts=parts):
            ar, ma, w = parts(theta, row)
            logs, squares, _ = _filter(w, known[row], ar, ma)
            return np.nan_to_num(np.log(np.maximum(squares, 1e-12)) + logs, nan=1e6, posinf=1e6)

        start = np.zeros((len(series), p + q + 1 + extras))
        start[:, p + q] = np.where(with_mean, mean0, 0)
        theta, value = minimise(loss, start, 40)
        ar, ma, w = parts(theta, np.arange(len(series)))
        _, squares, state = _filter(w, known, ar, ma)
        k = p + q + 1 + with_mean + extras
        aicc = count * (value + 1 + np.log(2 * np.pi)) + 2 * count * np.log(scale) + 2 * k + 2 * k * (k + 1) / np.maximum(count - k - 1, 0.5)
        for i in range(len(series)):
            if out[i] is None or aicc[i] < out[i]["aicc"] - 1e-6:
                out[i] = {"p": p, "d": many[i], "q": q, "ar": ar[i], "ma": ma[i], "mean": float(theta[i, p + q] * scale[i]) if with_mean[i] else 0.0, "sigma2": float(squares[i] * scale[i] ** 2), "aicc": float(aicc[i]), "state": state[i] * scale[i], "effect": float(theta[i, -1] * scale[i]) if extras else 0.0}
    return out


def predict_arima(fit: dict, y: np.ndarray, horizon: int, extra: np.ndarray | None = None) -> np.ndarray:
    """Forecasts after ``y``; the regressor is 0 from there on."""
    r = max(fit["p"], fit["q"] + 1)
    t = np.zeros((r, r))
    t[: fit["p"], 0] = fit["ar"]
    t[np.arange(r - 1), np.arange(1, r)] = 1.0
    a, steps = fit["state"].copy(), []
    for _ in range(horizon):
        steps.append(a[0] + fit["mean"])
        a = t @ a
    level = y - fit["effect"] * extra if extra is not None else y
    ends = [np.diff(level, k)[-1] for k in range(fit["d"])]
    out = np.array(steps)
    for k in reversed(range(fit["d"])):
        out = ends[k] + np.cumsum(out)
    return out


def _arrays(series: DataFrame) -> DataFrame:
    return indexed(series).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "y"))), lambda s: s["y"].cast("double")).alias("ys"))


def _dealt(series: DataFrame, least: int, horizon: int, stride: int) -> DataFrame:
    """(key, split, ys): a row a fold, over all tasks."""
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folds(series, least, horizon, stride).join(_arrays(series), "key").repartition(n, "key", "split")


def arima_forecasts(series: DataFrame, least: int, horizon: int = 1, stride: int = 1, most_p: int = 3, most_q: int = 3, spike: int = 0) -> DataFrame:
    """(key, split, idx, y, arima, p, d, q): forecasts by fold, not below 0; with ``spike`` the first values of a series have a level
    of their own."""
    kind = series.schema["key"].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), TOGETHER):
                f = whole.iloc[i : i + TOGETHER]
                ys = [np.asarray(y, float) for y in f.ys]
                train = [y[:s] for y, s in zip(ys, f.split, strict=True)]
                extra = [(np.arange(len(t)) < spike).astype(float) for t in train] if spike else None
                fits = fit_arima(train, most_p, most_q, extra)
                rows = []
                for j, (key, split, y, fit) in enumerate(zip(f.key, f.split, ys, fits, strict=True)):
                    guess = np.maximum(predict_arima(fit, train[j], horizon, extra[j] if spike else None), 0)
                    rows += [(key, split, split + h, y[split + h], guess[h], fit["p"], fit["d"], fit["q"]) for h in range(horizon)]
                yield pd.DataFrame(rows, columns=["key", "split", "idx", "y", "arima", "p", "d", "q"])

    return _dealt(series, least, horizon, stride).mapInPandas(of, f"key {kind}, split long, idx long, y double, arima double, p int, d int, q int")


# --- GARCH ------------------------------------------------------------------------------------------------------------
def _garch_parts(theta: np.ndarray) -> tuple:
    """Mean, long-run variance, alpha, beta: alpha and beta are shares of a persistence below 1."""
    persist = 0.999 / (1 + np.exp(-theta[:, 2]))
    share = 1 / (1 + np.exp(-theta[:, 3]))
    return theta[:, 0], np.exp(theta[:, 1]), persist * share, persist * (1 - share)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def _garch_loss(z: np.ndarray, known: np.ndarray, student: bool):
    def loss(theta: np.ndarray, row: np.ndarray) -> np.ndarray:
        mu, level, alpha, beta = _garch_parts(theta)
        e2 = (z[row] - mu[:, None]) ** 2
        on = known[row]
        omega = level * (1 - alpha - beta)
        v = (e2 * on).sum(1) / on.sum(1)
        total = np.zeros(len(row))
        nu = 2.05 + np.exp(np.clip(theta[:, 4], -10, 6)) if student else None
        for t in range(z.shape[1]):
            v = np.maximum(v if t == 0 else omega + alpha * e2[:, t - 1] + beta * v, 1e-12)
            one = np.log(v) + (e2[:, t] / v if not student else (nu + 1) * np.log1p(e2[:, t] / (v * (nu - 2))))
            total += np.where(on[:, t], one, 0)
        n = on.sum(1)
        if student:
            return 0.5 * total - n * (_lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(np.pi * (nu - 2)))
        return 0.5 * total + 0.5 * n * np.log(2 * np.pi)

    return loss


def fit_garch(series: list[np.ndarray], level: float = 5.991) -> list[dict]:
    """GARCH(1, 1) of each series by maximum likelihood: mu, omega, alpha, beta, aic, next_variance, nu (None: normal errors).

    Where the scaled residuals fail Jarque and Bera's test (chi-square of 2, 5 %), Student errors are fitted too and kept if
    their AIC is less.
    """
    scale = np.array([max(np.std(s), 1e-9) for s in series])
    z, known = _differenced([s / c for s, c in zip(series, scale, strict=True)], [0] * len(series))
    start = np.tile([0.0, 0.0, 2.0, -1.5], (len(series), 1))
    start[:, 0] = [np.mean(s) / c for s, c in zip(series, scale, strict=True)]
    theta, loss = minimise(_garch_loss(z, known, False), start, 120)
    out = []
    again = []
    for i, s in enumerate(series):
        fit = _garch_row(theta[i], s / scale[i], scale[i], 2 * 4 + 2 * (loss[i] + len(s) * np.log(scale[i])), None)
        u = fit.pop("scaled")
        m2, m3, m4 = (float(((u - u.mean()) ** k).mean()) for k in (2, 3, 4))
        fit["jb"] = len(u) / 6 * (m3**2 / m2**3 + (m4 / m2**2 - 3) ** 2 / 4)
        if fit["jb"] > level:
            again.append(i)
        out.append(fit)
    if again:
        wide, more = minimise(_garch_loss(z[again], known[again], True), np.column_stack([theta[again], np.full(len(again), 1.5)]), 120)
        for j, i in enumerate(again):
            nu = 2.05 + float(np.exp(np.clip(wide[j, 4], -10, 6)))
            fit = _garch_row(wide[j], series[i] / scale[i], scale[i], 2 * 5 + 2 * (more[j] + len(series[i]) * np.log(scale[i])), nu)
            fit.pop("scaled")
            if fit["aic"] < out[i]["aic"]:
                out[i] = fit | {"jb": out[i]["jb"]}
    return out


def _garch_row(theta: np.ndarray, z: np.ndarray, scale: float, aic: float, nu: float | None) -> dict:
    mu, level, alpha, beta = (float(x[0]) for x in _garch_parts(theta[None]))
    omega, e = level * (1 - alpha - beta), z - mu
    v = np.empty(len(z) + 1)
    v[0] = (e * e).mean()
    for t in range(len(z)):
        v[t + 1] = omega + alpha * e[t] ** 2 + beta * v[t]
    return {"mu": mu * scale, "omega": omega * scale**2, "alpha": alpha, "beta": beta, "aic": float(aic), "next_variance": float(v[-1] * scale**2), "nu": nu, "variances": v[:-1] * scale**2, "scaled": e / np.sqrt(v[:-1])}


def garch(series: DataFrame) -> DataFrame:
    """(key, n, mu, omega, alpha, beta, persistence, aic, nu, next_variance, variances) of the changes of each series of 20 or more."""
    kind = series.schema["key"].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), TOGETHER):
                f = whole.iloc[i : i + TOGETHER]
                changes = [np.diff(np.asarray(y, float)) for y in f.ys]
                fits = fit_garch(changes)
                rows = [(k, len(c), x["mu"], x["omega"], x["alpha"], x["beta"], x["alpha"] + x["beta"], x["aic"], x["nu"], x["next_variance"], x["variances"].tolist(), c.tolist()) for k, c, x in zip(f.key, changes, fits, strict=True)]
                yield pd.DataFrame(rows, columns=["key", "n", "mu", "omega", "alpha", "beta", "persistence", "aic", "nu", "next_variance", "variances", "changes"])

    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _arrays(series).where(F.size("ys") > 20).repartition(n, "key")
    return dealt.mapInPandas(of, f"key {kind}, n long, mu double, omega double, alpha double, beta double, persistence double, aic double, nu double, next_variance double, variances array<double>, changes array<double>")


# --- a trend with changepoints ----------------------------------------------------------------------------------------
def fit_changes(y: np.ndarray, horizon: int, changes: int = 25, tight: float = 0.05, season: float = 7.0, waves: int = 3, spread: float = 10.0, width: float = 1.2816) -> dict:
    """A line whose slope may change at points in the first four fifths, and waves of a season: forecasts with an 80 % interval.

    Changes of slope have a Laplace prior of scale ``tight`` (over a series scaled to its largest value and length 1), waves a
    normal one of scale ``spread``. The most likely values come from repeated weighted ridge steps, the noise from their rest. The
    interval adds to the noise the variance of changes to come, as frequent and as large on average as those found.
    """
    n = len(y)
    size = float(np.abs(y).max()) or 1.0
    t = np.arange(n + horizon) / max(n - 1, 1)
    at = np.linspace(0, 0.8, min(changes, max(1, int(0.8 * n) - 1)) + 1)[1:]
    angle = 2 * np.pi * np.arange(n + horizon)[:, None] * np.arange(1, waves + 1)[None] / season
    x = np.column_stack([np.ones(n + horizon), t, np.maximum(t[:, None] - at[None], 0), np.sin(angle), np.cos(angle)])
    k = len(at)
    known, goal = x[:n], y / size
    beta, noise = np.zeros(x.shape[1]), max(float(np.var(goal)), 1e-8)
    delta = np.full(k, tight)
    for _ in range(200):
        weight = np.concatenate([[1 / 25, 1 / 25], 1 / (tight * np.maximum(np.abs(delta), 1e-7)), np.full(2 * waves, 1 / spread**2)])
        new = np.linalg.solve(known.T @ known / noise + np.diag(weight), known.T @ goal / noise)
        rest = goal - known @ new
        noise = max(float(rest @ rest) / n, 1e-10)
        moved, beta, delta = float(np.abs(new - beta).max()), new, new[2 : 2 + k]
        if moved < 1e-9:
            break
    ahead = t[n:] - t[n - 1]
    size_of = float(np.abs(delta).mean())
    var = noise + k / 0.8 * 2 * size_of**2 * ahead**3 / 3
    guess = x[n:] @ beta
    return {"guess": guess * size, "half": width * np.sqrt(var) * size, "at": at * (n - 1), "change": delta * size / max(n - 1, 1), "fitted": known @ beta * size}


def change_forecasts(series: DataFrame, least: int, horizon: int, stride: int, season: float = 7.0) -> DataFrame:
    """(key, split, idx, y, trend, lo, hi): forecasts of ``fit_changes`` by fold, not below 0."""
    kind = series.schema["key"].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, split, y in zip(f.key, f.split, f.ys, strict=True):
                y = np.asarray(y, float)
                fit = fit_changes(y[:split], horizon, season=season)
                lo, mid, hi = (np.maximum(fit["guess"] + s * fit["half"], 0) for s in (-1, 0, 1))
                rows += [(key, split, split + h, y[split + h], mid[h], lo[h], hi[h]) for h in range(horizon)]
            yield pd.DataFrame(rows, columns=["key", "split", "idx", "y", "trend", "lo", "hi"])

    return _dealt(series, least, horizon, stride).mapInPandas(of, f"key {kind}, split long, idx long, y double, trend double, lo double, hi double")
