"""Exponential smoothing by likelihood against plain versions."""

import numpy as np
import pytest

from stockyard.operators import forecast


def _sse(y, alpha, start):
    level, total = start, 0.0
    for q in y:
        total += (q - level) ** 2
        level += alpha * (q - level)
    return total, level


def _best_start(y, alpha):
    """The start by plain regression of the errors from zero on their weights."""
    level, e = 0.0, []
    for q in y:
        e.append(q - level)
        level += alpha * (q - level)
    g = (1 - alpha) ** np.arange(len(y))
    return float(np.array(e) @ g / (g @ g))


def _parts(spark, series):
    rows = [(k, t, None if v is None else float(v), t < len(y)) for k, y in series.items() for t, v in enumerate([*y, 1.0])]
    return spark.createDataFrame(rows, "k string, t int, q double, train boolean")


def _levels(seed, n, alpha):
    g = np.random.default_rng(seed)
    level, y = 20.0, []
    for e in g.normal(size=n):
        y.append(level + e)
        level += alpha * e
    return y


def test_fit_has_the_least_error_over_a_fine_grid(spark):
    series = {f"s{a}": _levels(i, 150, a) for i, a in enumerate((0.05, 0.3, 0.7, 0.95))}
    parts = _parts(spark, series)
    got = {r.k: r for r in forecast.ses_likelihood(parts).collect()}
    coarse = {r.k: r for r in forecast.ses(parts).collect()}
    for k, y in series.items():
        r = got[k]
        sse, level = _sse(y, r.alpha, r.start)
        assert r.sse == pytest.approx(sse) and r.level == pytest.approx(level) and r.start == pytest.approx(_best_start(y, r.alpha))
        fine = min((_sse(y, a, _best_start(y, a))[0], a) for a in np.linspace(0, 1, 1001))
        assert r.sse <= fine[0] * (1 + 1e-12) and abs(r.alpha - fine[1]) < 1.01e-3
        assert r.sse <= _sse(y, coarse[k].alpha, float(np.mean(y[:10])))[0] * (1 + 1e-12)
        # A millionth to either side isn't better by more than rounding.
        assert all(r.sse <= _sse(y, a, _best_start(y, a))[0] * (1 + 1e-12) for a in (max(0, r.alpha - 1e-6), min(1, r.alpha + 1e-6)))
        assert r.aic == pytest.approx(len(y) * np.log(sse / len(y)) + 4)


def test_edges(spark):
    """One value, equal values, a walk's level at one, nulls as none, and no train days."""
    walk = list(np.cumsum([1.0] * 40))
    got = {r.k: r for r in forecast.ses_likelihood(_parts(spark, {"one": [4.0], "flat": [3.0] * 30, "walk": walk, "null": [2.0, None, 2.0, None], "none": []})).collect()}
    assert set(got) == {"one", "flat", "walk", "null"}
    assert got["one"].level == pytest.approx(4) and got["flat"].level == pytest.approx(3) and got["flat"].sse == pytest.approx(0)
    assert got["walk"].alpha == pytest.approx(1) and got["walk"].level == pytest.approx(40)
    assert got["null"].sse <= 4.0 + 1e-9
    assert forecast.ses_likelihood(_parts(spark, {"x": [1.0]}).limit(0)).count() == 0
