"""K-Means from many starts: against plain steps, against MLlib's best, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.operators import multistart as M


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k int, " + ", ".join(f"f{j} double" for j in range(x.shape[1]))).repartition(3)


def blobs(n=400, k=7, d=3, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(0, 4, (k, d))[r.integers(0, k, n)] + r.normal(0, 1.2, (n, d))


def inertia(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels))


def test_not_above_the_best_of_twenty(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = blobs()
    df = table(spark, x)
    rows, cost = M.fit_all(df, "k", ["f0", "f1", "f2"], [M.Fit("a", 7, 20), M.Fit("b", 3, 20), M.Fit("c", 7, 20, without=("f2",))])
    got = {}
    for r in rows.collect():
        got.setdefault(r.fit, np.zeros(len(x), int))[r.k] = r.cluster
    assert set(got) == {"a", "b", "c"} and all(len(np.unique(got[f])) == k for f, k in (("a", 7), ("b", 3), ("c", 7)))
    for f, y in (("a", x), ("b", x), ("c", x[:, :2])):
        assert inertia(y, got[f]) == pytest.approx(cost[f], rel=1e-3)
    v = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="v").transform(df)
    best = min(KMeans(k=7, seed=s, maxIter=100, featuresCol="v").fit(v).summary.trainingCost for s in range(20))
    assert cost["a"] <= best * (1 + 1e-4)


def test_step_is_plain(spark):
    x = blobs(120, 4, 2, 5)
    c = {0: x[:4].copy(), 1: x[10:13].copy(), 2: np.vstack([x[:2], [[1e6, 1e6]]])}
    got = M._step(M.stored(table(spark, x), "k", ["f0", "f1"]), 2, c, {i: np.ones(2, bool) for i in c})
    for i, centres in c.items():
        far = ((x[:, None] - centres[None]) ** 2).sum(2)
        who = far.argmin(1)
        want = np.array([x[who == j].mean(0) if (who == j).any() else centres[j] for j in range(len(centres))])
        assert np.allclose(got[i][0], want) and got[i][1] == pytest.approx(far.min(1).sum())


def test_draws_follow_the_squared_distance(spark):
    """The second centre of one try: far points win in proportion; the same table in other partitions draws the same."""
    x = np.array([[0.0]] * 50 + [[1.0], [3.0]])
    points = M.stored(table(spark, x), "k", ["f0"])
    draws = [(s, np.ones(1, bool), 2) for s in range(200)]
    one = M._seeded(points, 1, draws)
    two = M._seeded(points.repartition(7), 1, draws)
    assert all((a == b).all() for a, b in zip(one, two, strict=True))
    # Greedy draws keep the point that leaves the least: 3 leaves 1, 1 leaves 4.
    assert sum(c[1, 0] == 3.0 for c in one if c[0, 0] == 0.0) > 150


def test_odd_tables(spark):
    same = table(spark, np.zeros((9, 2)))
    rows, cost = M.fit_all(same, "k", ["f0", "f1"], [M.Fit("a", 3, 2)])
    assert cost == {"a": 0.0} and rows.count() == 9
    assert M.fit_all(same.where("k < 0"), "k", ["f0", "f1"], [M.Fit("a", 3, 2)])[0].count() == 0
    odd = same.withColumn("f0", F.when(F.col("k") == 1, None).when(F.col("k") == 2, float("nan")).otherwise(F.col("f0")))
    assert M.fit_all(odd, "k", ["f0", "f1"], [M.Fit("a", 2, 1)])[0].count() == 7
    one, _ = M.fit_all(same.where("k = 3"), "k", ["f0", "f1"], [M.Fit("a", 4, 1)])
    assert one.count() == 1
