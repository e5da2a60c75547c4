"""The sweep over k on copies: equal points are one with a weight, and all fits are rated in one pass."""

import math

import numpy as np
import pytest

from stockyard.operators import cluster as K
from stockyard.operators import multistart as M


def _table(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k int, " + ", ".join(f"f{j} double" for j in range(x.shape[1]))).repartition(3)


def test_equal_points_are_one_with_a_weight(spark):
    x = np.random.default_rng(3).normal(size=(40, 2))
    once = M.stored(_table(spark, x), "k", ["f0", "f1"])
    met = M._distinct(M.stored(_table(spark, np.vstack([x] * 5)), "k", ["f0", "f1"]))
    assert met.count() == 40 and {r.n for r in met.collect()} == {5}
    now, masks = {0: x[:3].copy(), 1: x[5:9].copy(), 2: np.vstack([x[:2], x[:1]])}, {0: np.ones(2, bool), 1: np.array([True, False]), 2: np.ones(2, bool)}
    a, b = M._step(once, 2, now, masks), M._step(met, 2, now, masks)
    for i in now:
        assert np.allclose(a[i][0], b[i][0]) and b[i][1] == pytest.approx(5 * a[i][1])
    assert (a[2][0][2] == now[2][2]).all()  # of equal centres the first has the points, and the last stays


def test_fits_are_rated_together(spark):
    """quality() and the silhouettes of all fits at once are those of each alone."""
    r = np.random.default_rng(4)
    x = r.normal(0, 3, (4, 2))[r.integers(0, 4, 90)] + r.normal(size=(90, 2))
    df, names = _table(spark, x), ["f0", "f1"]
    fits = [M.Fit("a", 3, 2), M.Fit("b", 5, 2), M.Fit("one", 1, 1)]
    points, cost = M.fit_all(df, "k", names, fits, 50, 1e-4, True)
    assert points.columns == ["k", "fit", "cluster", *names] and points.count() == 270 and set(cost) == {"a", "b", "one"}
    together = {q.fit: q for q in K.quality(points.where("fit <> 'one'"), names, "cluster", ["fit"]).collect()}
    sil = {s.fit: s.silhouette for s in K.sampled_silhouettes(points, "k", names, "cluster", "fit", 3, 60).collect()}
    for f in ("a", "b"):
        alone = points.where(f"fit = '{f}'")
        q = K.quality(alone, names, "cluster").first()
        assert all(math.isclose(q[c], together[f][c], rel_tol=1e-9) for c in ("k", "n", "calinski_harabasz", "davies_bouldin"))
        s = [v.silhouette for v in K.silhouette(alone, "k", names, "cluster", 60).collect()]
        assert len(s) == 60 and sil[f] == pytest.approx(sum(s) / 60, abs=1e-9)
    assert sil["one"] == 0.0
