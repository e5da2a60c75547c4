"""ARIMA and seasonal ARIMA by exact Gaussian likelihood, one series a task's call.

An ARMA process in innovations form is w[t] = x[t][0] + e[t], x[t+1] = T x[t] + (ar + ma) e[t], with T the companion matrix of the
autoregression. Whatever state x the series starts from, its innovations are linear in it: e = a - G x, where a are the innovations from an
empty past and column j of G is the impulse response h of one over the moving average, j steps late. So with the stationary law x ~ N(0, s2 P)
the state integrates out in closed form (Ljung and Box, Biometrika 1979), and

    -2 log L = n log(2 pi s2) + log|I + P G'G| + (a'a - a'G (I + P G'G)^-1 P G'a) / s2

needs no filter over covariances: two recursive filters and matrices as wide as the longer polynomial. Parameters are searched as partial
autocorrelations (Monahan 1984), so every point is stationary and invertible; s2 has its best value in closed form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stockyard.functions import tails

ORDERS = tuple((p, d, q) for d in range(2) for p in range(3) for q in range(3))
FALLBACK = (1, 1, 1)
_BLOCK = 64


def recursive(x: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """y with y[t] + ma[0] y[t-1] + ... = x[t] and nothing before the first, along the last axis of x (rows, n)."""
    m, (rows, n) = len(ma), x.shape
    if not m:
        return x.copy()
    b = max(_BLOCK, m)
    terms, h = [(i, float(c)) for i, c in enumerate(ma, 1) if c], [0.0] * b + [1.0]
    for t in range(b + 1, 2 * b):
        h.append(-sum([c * h[t - i] for i, c in terms]))
    # Row t holds the response, newest first: a window that slides over zeros and h.
    inside = np.lib.stride_tricks.sliding_window_view(np.array(h[1:])[::-1], b)[::-1]
    reach = np.zeros((b, m))
    for t in range(m):
        reach[t, : m - t] = -ma[t:]
    reach = inside @ reach
    blocks = -(-n // b)
    padded = np.zeros((rows, blocks * b))
    padded[:, :n] = x
    y = padded.reshape(rows, blocks, b) @ inside.T
    for i in range(1, blocks):
        y[:, i] += y[:, i - 1, : -m - 1 : -1] @ reach.T
    return y.reshape(rows, -1)[:, :n]


def _companion(first: np.ndarray) -> np.ndarray:
    m = np.eye(len(first), k=1)
    m[:, 0] = first
    return m


def _stationary(t: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P = T P T' + k k' by doubling."""
    p, a = np.outer(k, k), t
    for _ in range(60):
        step = a @ p @ a.T
        p = p + step
        if not np.abs(step).max() > 1e-15 * np.abs(p).max():
            break
        a = a @ a
    return p


def _parts(w: np.ndarray, ar: np.ndarray, ma: np.ndarray):
    """m, a, G, P of the likelihood, with both polynomials as long as the longer."""
    n, m = len(w), max(len(ar), len(ma))
    if not m:
        return ar, ma, w, np.zeros((n, 0)), np.zeros((0, 0))
    phi, theta = np.r_[ar, np.zeros(m - len(ar))], np.r_[ma, np.zeros(m - len(ma))]
    x = np.zeros((2, n))
    x[0] = w
    for i, c in enumerate(ar[: n - 1], 1):
        x[0, i:] -= c * w[:-i]
    x[1, 0] = 1.0
    a, h = recursive(x, ma)
    g = np.zeros((n, m))
    for j in range(min(m, n)):
        g[j:, j] = h[: n - j]
    return phi, theta, a, g, _stationary(_companion(phi), phi + theta)


def likelihood(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, s2: float | None = None) -> tuple[float, float]:
    """Exact log-likelihood of w under ARMA with these coefficients, and s2: as given, or the best."""
    n = len(w)
    _, _, a, g, p = _parts(w, ar, ma)
    square, logdet = float(a @ a), 0.0
    if g.shape[1]:
        inner, ga = np.eye(g.shape[1]) + p @ (g.T @ g), g.T @ a
        logdet = float(np.linalg.slogdet(inner)[1])
        square -= float(ga @ np.linalg.solve(inner, p @ ga))
    if s2 is None:
        s2 = max(square / n, 1e-300)
    return -0.5 * (n * math.log(2 * math.pi * s2) + logdet + square / s2), s2


def stationary_coefficients(z: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any numbers, by way of partial autocorrelations z / sqrt(1 + z^2)."""
    out = np.zeros(0)
    for r in z / np.sqrt(1 + z * z):
        out = np.r_[out - r * out[::-1], r]
    return out


def free_numbers(coefficients: np.ndarray) -> np.ndarray:
    """The inverse of stationary_coefficients; coefficients outside are drawn in."""
    c, r = np.array(coefficients, float), []
    while len(c):
        last = float(np.clip(c[-1], -0.97, 0.97))
        r.append(last)
        c = (c[:-1] + last * c[-2::-1]) / (1 - last * last) if len(c) > 1 else c[:-1]
    r = np.array(r[::-1])
    return r / np.sqrt(1 - r * r)


@dataclass(frozen=True)
class Model:
    """Orders (p, d, q) x (sp, 0, sq, period), and after a fit its polynomials, variance and log-likelihood."""

    order: tuple[int, int, int]
    seasonal: tuple[int, int, int] = (0, 0, 0)
    ar: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ma: np.ndarray = field(default_factory=lambda: np.zeros(0))
    s2: float = 0.0
    loglik: float = float("nan")
    free: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * (self.order[0] + self.order[2] + sum(self.seasonal[:2]) + 1)


def _spread(c: np.ndarray, period: int) -> np.ndarray:
    """Polynomial 1 + c[0] B^period + ... as an array from lag 0."""
    out = np.zeros(len(c) * max(period, 1) + 1)
    out[0] = 1.0
    if len(c):
        out[period::period] = c
    return out


def polynomials(free: np.ndarray, order, seasonal) -> tuple[np.ndarray, np.ndarray]:
    """ar and ma of the product of both parts, from free numbers (p, q, sp, sq)."""
    (p, _, q), (sp, sq, period) = order, seasonal
    a, b, sa, sb = (stationary_coefficients(z) for z in np.split(free, np.cumsum([p, q, sp])))
    return -np.convolve(_spread(-a, 1), _spread(-sa, period))[1:], np.convolve(_spread(-b, 1), _spread(-sb, period))[1:]


def _descend(f, x: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """A least point near x by BFGS on central differences, with halved steps."""

    def slope(x):
        h = 1e-5 * np.maximum(1.0, np.abs(x))
        return np.array([(f(x + e) - f(x - e)) / (2 * e.sum()) for e in np.diag(h)])

    y, g, inverse, fresh = f(x), slope(x), np.eye(len(x)), True
    for _ in range(steps):
        if not np.isfinite(g).all() or np.abs(g).max() < 1e-7:
            break
        move = -inverse @ g
        if move @ g >= 0:
            inverse, move, fresh = np.eye(len(x)), -g, True
        if fresh:
            # No scale known yet: at most a step of one half.
            move = move * min(1.0, 0.5 / np.abs(move).max())
        size, found = 1.0, False
        for _ in range(25):
            got = f(x + size * move)
            if got <= y + 1e-4 * size * (move @ g):
                found = True
                break
            size /= 2
        if not found:
            if fresh:
                break
            inverse, fresh = np.eye(len(x)), True
            continue
        new = x + size * move
        gn = slope(new)
        s, v = new - x, gn - g
        gain = y - got
        x, y, g = new, got, gn
        if (sv := s @ v) > 1e-14:
            if fresh:
                inverse = np.eye(len(x)) * sv / (v @ v)
            left = np.eye(len(x)) - np.outer(s, v) / sv
            inverse = left @ inverse @ left.T + np.outer(s, s) / sv
            fresh = False
        if gain < 1e-11 * max(1.0, abs(y)):
            break
    return x, y


def _guess(w: np.ndarray, p: int, q: int) -> np.ndarray:
    """Free numbers from Hannan and Rissanen's regression: innovations of a long autoregression stand for the ma terms."""
    n, long = len(w), 0
    e = np.zeros(n)
    if q:
        long = min(20, n // 4)
        x = np.column_stack([w[long - i : n - i] for i in range(1, long + 1)])
        e[long:] = w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]
    m = long + max(p, q)
    x = np.column_stack([*[w[m - i : n - i] for i in range(1, p + 1)], *[e[m - i : n - i] for i in range(1, q + 1)]])
    b = np.linalg.lstsq(x, w[m:], rcond=None)[0]
    return np.r_[free_numbers(b[:p]), free_numbers(-b[p:])]


def fit(y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int] = (0, 0, 0), start: np.ndarray | None = None) -> Model:
    """The model of these orders with the most likelihood for y differenced d times, searched from the regression's start or the one given, mixed models also from near zero."""
    (p, d, q), (sp, sq, _) = order, seasonal
    w = np.diff(y, d)
    scale = math.sqrt(float(w @ w) / len(w))
    if scale == 0:
        return Model(order, seasonal, loglik=math.inf)
    u, dim = w / scale, p + q + sp + sq

    def cost(free):
        # The mean over days: steps and gradients then have one size, whatever the length.
        got = -likelihood(u, *polynomials(free, order, seasonal))[0] / len(u)
        return got if math.isfinite(got) else math.inf

    best = np.zeros(dim)
    if dim:
        seed = _guess(u, p, q) if start is None and p + q else np.zeros(p + q) if start is None else start
        # A second start where ar and ma terms can trade places; one kind alone has one peak but for rare series.
        starts = [np.r_[seed, np.full(sp + sq, 0.1)], *([np.full(dim, 0.1)] if p + sp and q + sq else [])]
        best = min((_descend(cost, s) for s in starts), key=lambda r: r[1])[0]
    ar, ma = polynomials(best, order, seasonal)
    loglik, s2 = likelihood(w, ar, ma)
    return Model(order, seasonal, ar, ma, s2, loglik, best)


def innovations(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Innovations with the first state at its mean given the whole series."""
    _, _, a, g, p = _parts(w, ar, ma)
    if not g.shape[1]:
        return a
    return a - g @ np.linalg.solve(np.eye(g.shape[1]) + p @ (g.T @ g), p @ (g.T @ a))


def forecast(y: np.ndarray, model: Model, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors of the next steps; errors from the psi weights, summed once for each difference."""
    d = model.order[1]
    w = np.diff(y, d)
    e = innovations(w, model.ar, model.ma)
    m, n = max(len(model.ar), len(model.ma)), len(w)
    ww, ee = np.r_[w, np.zeros(steps)], np.r_[e, np.zeros(steps)]
    psi = np.zeros(steps + m)
    psi[m] = 1.0
    late = np.zeros(steps + m)
    late[m] = 1.0
    for t in range(steps):
        now = n + t
        ww[now] = sum(c * ww[now - i] for i, c in enumerate(model.ar, 1)) + sum(c * ee[now - i] for i, c in enumerate(model.ma, 1))
        if t:
            psi[m + t] = sum(c * psi[m + t - i] for i, c in enumerate(model.ar, 1)) + sum(c * late[m + t - i] for i, c in enumerate(model.ma, 1))
    f, psi = ww[n:], psi[m:]
    for k in range(d, 0, -1):
        f = np.diff(y, k - 1)[-1] + np.cumsum(f)
        psi = np.cumsum(psi)
    return f, np.sqrt(model.s2 * np.cumsum(psi**2))


def best_model(y: np.ndarray, orders=ORDERS) -> Model:
    """The order with least AIC (ties: the first); orders for which the series is too short or doesn't move are left out, FALLBACK if all are."""
    fits = [fit(y, o) for o in orders if len(y) - o[1] >= 4 * (o[0] + o[2]) + 30 and np.ptp(np.diff(y, o[1])) > 0]
    return min(fits, key=lambda m: m.aic) if fits else Model(FALLBACK if not orders else orders[0], loglik=math.inf)


def ljung_box_p(e: np.ndarray, lags: int = 10) -> float | None:
    e = e - e.mean()
    n, square = len(e), float(e @ e)
    if not square or n <= lags:
        return None
    return tails.chi2_upper(n * (n + 2) * sum((float(e[i:] @ e[:-i]) / square) ** 2 / (n - i) for i in range(1, lags + 1)), lags)


SCHEMA = "k string, date date, q double, model string, forecast double, low double, high double, p_order int, d_order int, q_order int, aic double, ljung_box_p double"


def forecasts(parts: DataFrame, models: tuple[str, ...] = ("ARIMA",), period: int = 7, orders=ORDERS, shortest: int = 60) -> DataFrame:
    """SCHEMA for the test days of parts (k, date, q, t, train), for each of `models`. ARIMA: the order of least AIC over `orders`, no trend. SARIMA: that order times
    (1, 0, 1, period). Each series is one value of its group (days, not events). Series with fewer than `shortest` train days, or with all train days equal,
    have no rows; null demand counts as none."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        train, test = pdf[pdf["train"]], pdf[~pdf["train"]]
        y = train["q"].fillna(0.0).to_numpy(float)
        if not len(test) or len(y) < shortest or np.ptp(y) == 0:
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        plain, out = best_model(y, orders), []
        for name in models:
            m = plain if name == "ARIMA" else fit(y, plain.order, (1, 1, period), start=plain.free)
            f, se = forecast(y, m, len(test))
            p = ljung_box_p(innovations(np.diff(y, m.order[1]), m.ar, m.ma))
            rows = {"k": test["k"].values, "date": test["date"].values, "q": test["q"].values, "model": name, "forecast": f, "low": f - 1.96 * se, "high": f + 1.96 * se}
            out.append(pd.DataFrame(rows | dict(zip(("p_order", "d_order", "q_order"), m.order, strict=True)) | {"aic": m.aic, "ljung_box_p": p}))
        return pd.concat(out)

    # A number of partitions of its own, so that adaptive execution doesn't join what is little data but much work.
    n = 4 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("k", "date", "q", "t", "train").repartition(n, "k").groupBy("k").applyInPandas(run, SCHEMA)
