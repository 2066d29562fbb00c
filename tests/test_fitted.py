"""Fitted models recover what simulated series were made with."""

import datetime as dt

import numpy as np
import pytest

from talkloom.operators import fitted


def arma(r, n, ar=(), ma=(), mean=0.0):
    e, y = r.normal(size=n + 200), np.zeros(n + 200)
    for t in range(3, n + 200):
        y[t] = e[t] + sum(a * y[t - k - 1] for k, a in enumerate(ar)) + sum(b * e[t - k - 1] for k, b in enumerate(ma))
    return y[200:] + mean


def test_arima_recovers_coefficients_and_orders():
    r = np.random.default_rng(5)
    series = [arma(r, 900, (0.6, -0.3), (), 4.0), arma(r, 900, (), (0.7,)), arma(r, 700, (0.8,), (-0.4,))]
    first, second, third = (fitted.fit_arima([s], orders=[o])[0] for s, o in zip(series, [(2, 0), (0, 1), (1, 1)], strict=True))
    assert first["ar"] == pytest.approx([0.6, -0.3], abs=0.08) and first["mean"] == pytest.approx(4.0, abs=0.2)
    assert second["ma"] == pytest.approx([0.7], abs=0.08)
    assert (*third["ar"], *third["ma"]) == pytest.approx((0.8, -0.4), abs=0.2)
    assert all(f["sigma2"] == pytest.approx(1.0, abs=0.12) and f["d"] == 0 for f in (first, second, third))
    chosen = fitted.fit_arima(series, 2, 1)  # together, and never worse than the true order
    assert all(c["aicc"] <= f["aicc"] + 1e-3 for c, f in zip(chosen, (first, second, third), strict=True))
    assert chosen[0]["p"] == 2 and chosen[1]["q"] == 1


def test_likelihood_is_that_of_the_joint_normal():
    r = np.random.default_rng(1)
    z, ar, ma = r.normal(size=(1, 12)), np.array([[0.5, 0.2]]), np.array([[0.4]])
    weights = [1.0, 0.9]  # of past shocks
    for k in range(2, 400):
        weights.append(0.5 * weights[-1] + 0.2 * weights[-2])
    w = np.array(weights)
    cov = np.array([[w[abs(i - j) :] @ w[: len(w) - abs(i - j)] for j in range(12)] for i in range(12)])
    logs, squares, _ = fitted._filter(z, np.ones((1, 12), bool), ar, ma)
    assert 12 * logs[0] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-6)
    assert 12 * squares[0] == pytest.approx(float(z[0] @ np.linalg.solve(cov, z[0])), abs=1e-6)


def test_differences_spike_and_forecasts():
    r = np.random.default_rng(2)
    walk = np.cumsum(r.normal(size=300)) + 50
    assert fitted.differences(walk) == 1 and fitted.differences(arma(r, 300, (0.3,))) == 0
    fit = fitted.fit_arima([walk], 1, 1)[0]
    assert fitted.predict_arima(fit, walk, 3)[0] == pytest.approx(walk[-1], abs=1.5)
    y = arma(r, 200, (0.5,), (), 20.0)
    spike = (np.arange(200) < 5).astype(float)
    fit = fitted.fit_arima([y + 30 * spike], 1, 0, [spike], d=0)[0]
    assert fit["effect"] == pytest.approx(30, abs=2) and fit["ar"] == pytest.approx([0.5], abs=0.15)
    ahead = fitted.predict_arima(fit, y + 30 * spike, 40, spike)
    assert ahead[-1] == pytest.approx(fit["mean"], abs=0.01) and fit["mean"] == pytest.approx(20, abs=0.6)


def simulated_garch(r, n, omega, alpha, beta, shocks):
    v, e = omega / (1 - alpha - beta), np.zeros(n)
    for t in range(n):
        e[t] = np.sqrt(v) * shocks[t]
        v = omega + alpha * e[t] ** 2 + beta * v
    return e


def test_garch_recovers_parameters_and_refits_heavy_tails():
    r = np.random.default_rng(3)
    n = 5000
    t = r.standard_t(5, n) / np.sqrt(5 / 3)
    plain, heavy = fitted.fit_garch([10 + simulated_garch(r, n, 2.0, 0.15, 0.75, r.normal(size=n)), simulated_garch(r, n, 0.5, 0.1, 0.8, t)])
    assert plain["nu"] is None and (plain["alpha"], plain["beta"]) == pytest.approx((0.15, 0.75), abs=0.06)
    assert plain["omega"] / (1 - plain["alpha"] - plain["beta"]) == pytest.approx(20, rel=0.2) and plain["mu"] == pytest.approx(10, abs=0.3)
    assert heavy["nu"] == pytest.approx(5, abs=1.5) and (heavy["alpha"], heavy["beta"]) == pytest.approx((0.1, 0.8), abs=0.08)


def test_changepoints_are_found():
    r = np.random.default_rng(4)
    i = np.arange(300)
    level = 100 + 0.5 * i - 1.5 * np.maximum(i - 150, 0)
    fit = fitted.fit_changes(level + 8 * np.sin(2 * np.pi * i / 7) + r.normal(size=300), 20)
    near = np.abs(fit["at"] - 150) < 25
    assert fit["change"][near].sum() == pytest.approx(-1.5, abs=0.2)
    assert np.abs(fit["change"][~near]).sum() < 0.3
    after = np.arange(300, 320)
    truth = 100 + 0.5 * after - 1.5 * (after - 150) + 8 * np.sin(2 * np.pi * after / 7)
    assert np.abs(fit["guess"] - truth).max() < 5
    assert (np.diff(fit["half"]) > 0).all() and fit["half"][0] == pytest.approx(1.28, abs=0.3)


def test_folds_are_rows(spark):
    r = np.random.default_rng(6)
    rows = [(k, dt.date(2025, 1, 1) + dt.timedelta(days=i), float(20 + 3 * np.sin(i) + r.normal())) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "key string, ds date, y double")
    got = fitted.arima_forecasts(df, 30, 2, 4, 1, 1).collect()
    assert {(g.key, g.split) for g in got} == {(k, s) for k in "ab" for s in (30, 34, 38)} and len(got) == 12
    again = fitted.arima_forecasts(df.repartition(7), 30, 2, 4, 1, 1).collect()
    assert {(g.key, g.idx): round(g.arima, 3) for g in got} == {(g.key, g.idx): round(g.arima, 3) for g in again}
    band = fitted.change_forecasts(df, 30, 2, 4).collect()
    assert len(band) == 12 and all(g.lo <= g.trend <= g.hi for g in band)
    assert {g.key for g in fitted.garch(df).collect()} == {"a", "b"}
