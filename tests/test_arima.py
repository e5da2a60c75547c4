"""ARIMA by likelihood: the likelihood against the plain normal law, fits, forecasts and their intervals."""

import datetime
import math

import numpy as np
import pytest

from stockyard.operators import arima


def _psi(ar, ma, n):
    psi = [1.0]
    for t in range(1, n):
        psi.append(sum(c * psi[t - i] for i, c in enumerate(ar, 1) if t >= i) + (ma[t - 1] if t <= len(ma) else 0.0))
    return np.array(psi)


def _covariance(ar, ma, n):
    psi = _psi(ar, ma, 3000)
    g = [float(psi[: len(psi) - k] @ psi[k:]) for k in range(n)]
    return np.array([[g[abs(i - j)] for j in range(n)] for i in range(n)])


def _series(ar, ma, n, seed, burn=300):
    e = np.random.default_rng(seed).normal(size=n + burn)
    y = np.zeros(n + burn)
    for t in range(n + burn):
        y[t] = e[t] + sum(c * y[t - i] for i, c in enumerate(ar, 1) if t >= i) + sum(c * e[t - i] for i, c in enumerate(ma, 1) if t >= i)
    return y[burn:]


@pytest.mark.parametrize(
    ("order", "seasonal", "free"),
    [((0, 0, 0), (0, 0, 0), []), ((1, 0, 1), (0, 0, 0), [0.7, -0.4]), ((0, 0, 2), (0, 0, 0), [0.5, 0.9]), ((2, 0, 0), (0, 0, 0), [1.5, -0.4]), ((2, 0, 2), (1, 1, 7), [0.3, -0.5, 0.4, 0.2, 0.6, -0.3]), ((0, 0, 1), (1, 1, 7), [0.2, 0.8, 0.8])],
)
@pytest.mark.parametrize("n", [5, 80])
def test_likelihood_is_the_normal_law(order, seasonal, free, n):
    ar, ma = arima.polynomials(np.array(free, float), order, seasonal)
    w = np.random.default_rng(1).normal(size=n)
    c = _covariance(ar, ma, n) * 1.7
    want = -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + w @ np.linalg.solve(c, w))
    assert arima.likelihood(w, ar, ma, 1.7)[0] == pytest.approx(want, rel=1e-9)
    best, s2 = arima.likelihood(w, ar, ma)
    assert all(best >= arima.likelihood(w, ar, ma, s2 * k)[0] for k in (0.9, 1.1))


def test_recursive_filter_is_the_plain_recursion():
    x = np.random.default_rng(2).normal(size=(2, 203))
    for ma in (np.array([0.5]), np.array([-1.2, 0.4]), np.array([0.3, 0, 0, 0, 0, 0, 0.6, 0.18])):
        y = x.copy()
        for t in range(203):
            for i, c in enumerate(ma, 1):
                if t >= i:
                    y[:, t] -= c * y[:, t - i]
        assert np.allclose(arima.recursive(x, ma), y)


def test_free_numbers_come_back():
    for z in ([0.4], [1.5, -0.7], [0.1, 0.2, -0.3]):
        assert arima.free_numbers(arima.stationary_coefficients(np.array(z))) == pytest.approx(z)
    for z in np.random.default_rng(4).normal(0, 3, (50, 2)):
        assert np.abs(np.roots(np.r_[1, -arima.stationary_coefficients(z)])).max() < 1


def test_fit_finds_the_coefficients_and_the_most_likelihood():
    y = _series([0.8], [0.4], 2000, 5)
    m = arima.fit(y, (1, 0, 1))
    assert m.ar == pytest.approx([0.8], abs=0.06) and m.ma == pytest.approx([0.4], abs=0.08) and m.s2 == pytest.approx(1, abs=0.1)
    grid = max(arima.likelihood(y, np.array([a]), np.array([b]))[0] for a in np.arange(0.7, 0.9, 0.01) for b in np.arange(0.3, 0.5, 0.01))
    assert m.loglik >= grid - 1e-6
    assert m.aic == pytest.approx(-2 * m.loglik + 6)


def test_seasonal_terms_are_found():
    ar, ma = arima.polynomials(np.array([0.5, 0.3, 1.5, -0.8]), (1, 0, 1), (1, 1, 7))
    y = _series(ar, ma, 1500, 6)
    plain, m = arima.fit(y, (1, 0, 1)), arima.fit(y, (1, 0, 1), (1, 1, 7))
    assert m.ar[6] == pytest.approx(ar[6], abs=0.08) and m.ma[6] == pytest.approx(ma[6], abs=0.12)
    assert m.aic < plain.aic - 100 and arima.ljung_box_p(arima.innovations(y, m.ar, m.ma)) > 0.001


def test_grid_takes_the_difference_of_a_walk():
    y = np.cumsum(_series([0.6], [], 900, 7)) + 50
    m = arima.best_model(y)
    assert m.order[1] == 1
    f, se = arima.forecast(y, m, 30)
    assert se[0] == pytest.approx(1, abs=0.1) and se[-1] > 5 * se[0] and abs(f[0] - y[-1]) < 5


@pytest.mark.parametrize(("order", "seasonal", "free"), [((1, 0, 1), (0, 0, 0), [0.9, -0.4]), ((1, 1, 0), (0, 0, 0), [0.5]), ((1, 0, 0), (1, 1, 7), [0.4, 0.9, -0.4])])
def test_forecasts_are_conditional_means(order, seasonal, free):
    """Against the normal law of the future given the past; differences are summed up."""
    ar, ma = arima.polynomials(np.array(free), order, seasonal)
    n, steps, d = 90, 12, order[1]
    y = np.random.default_rng(8).normal(size=n + d).cumsum()
    w = np.diff(y, d)
    c = _covariance(ar, ma, n + steps) * 2.0
    gain = np.linalg.solve(c[:n, :n], c[:n, n:]).T
    mean, var = gain @ w, c[n:, n:] - gain @ c[:n, n:]
    for _ in range(d):
        total = np.tril(np.ones((steps, steps)))
        mean, var = y[-1] + total @ mean, total @ var @ total.T
    f, se = arima.forecast(y, arima.Model(order, seasonal, ar, ma, 2.0), steps)
    assert f == pytest.approx(mean, rel=1e-6, abs=1e-6) and se == pytest.approx(np.sqrt(np.diag(var)), rel=1e-3)


def test_intervals_cover():
    inside = []
    for seed in range(80):
        y = _series([0.7], [0.3], 320, 100 + seed)
        f, se = arima.forecast(y[:300], arima.fit(y[:300], (1, 0, 1)), 20)
        inside.append(np.abs(y[300:] - f) <= 1.96 * se)
    assert 0.92 < np.mean(inside) < 0.975


def test_by_series(spark):
    """Series with too few days, of one value, without test days, and with nulls."""
    rows = []
    for k, n, tests in (("long", 150, 10), ("short", 30, 10), ("no test", 150, 0)):
        y = _series([0.7], [], n, 9) + 3
        rows += [(k, datetime.date(2024, 1, 1) + datetime.timedelta(t), float(v) if t != 20 else None, t, t < n - tests) for t, v in enumerate(y)]
    rows += [("flat", datetime.date(2024, 1, 1) + datetime.timedelta(t), 2.0, t, t < 140) for t in range(150)]
    parts = spark.createDataFrame(rows, "k string, date date, q double, t int, train boolean")
    got = arima.forecasts(parts, ("ARIMA", "SARIMA"), orders=((1, 0, 0), (0, 0, 1))).collect()
    assert {(r.k, r.model) for r in got} == {("long", "ARIMA"), ("long", "SARIMA")} and len(got) == 20
    assert all(r.low < r.forecast < r.high and r.p_order == 1 for r in got)
    assert arima.forecasts(parts.limit(0)).count() == 0
