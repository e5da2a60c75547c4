"""Nearest neighbours by blocks against all pairs: ties, copies, missing values, groups at their least."""

import math

import numpy as np
import pytest

from stockyard.operators import anomaly as A


def _plain(rows, k):
    """{(g, id): [(d, id)] * k}: all pairs, by distance and then id; a missing feature is infinitely far."""
    out = {}
    for g, i, x in rows:
        d = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y, strict=True))) if None not in x + y else math.inf, j) for h, j, y in rows if h == g and j != i)
        if len(d) >= k:
            out[g, i] = d[:k]
    return out


def _lof(near, k):
    kd = {a: n[k - 1][0] for a, n in near.items()}
    lrd = {a: 1 / (sum(max(d, kd[a[0], b]) for d, b in n) / k + 1e-10) for a, n in near.items()}
    return {a: sum(lrd[a[0], b] for _, b in n) / k / lrd[a] for a, n in near.items()}


def _rows():
    r = np.random.default_rng(6)
    rows = [("a", i, [float(v) for v in r.integers(0, 4, 2)]) for i in range(120)]  # many ties and copies
    rows += [("b", i, [float(v) for v in r.normal(size=2)]) for i in range(60)] + [("b", 60, [50.0, -50.0])]
    rows += [("six", i, [float(i), 0.0]) for i in range(6)] + [("five", i, [float(i), 0.0]) for i in range(5)]
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_lof_is_that_of_all_pairs(spark, block):
    rows = _rows()
    df = spark.createDataFrame([(g, i, *x) for g, i, x in rows], "g string, id int, x double, y double").repartition(3)
    near, found = _plain(rows, 5), {}
    named, got = A.neighbours(df, ["id"], ["x", "y"], ["g"], 5, block, 4)
    ids = {(r.g, r._rid): r.id for r in named.collect()}
    for r in got.collect():
        found[r.g, ids[r.g, r.a]] = [(p.d, ids[r.g, p.b]) for p in r.near]
        assert r.kd == r.near[-1].d
    assert found == near and not any(g == "five" for g, _ in found)
    want = _lof(near, 5)
    scores = {(r.g, r.id): r.lof for r in A.lof(df, ["id"], ["x", "y"], ["g"], 5, block).collect()}
    assert scores.keys() == want.keys() and all(math.isclose(scores[a], want[a], rel_tol=1e-9) for a in want)


def test_a_missing_feature_is_far_from_all(spark):
    rows = [("a", i, [float(i), None if i == 3 else 1.0]) for i in range(12)]
    df = spark.createDataFrame([(g, i, *x) for g, i, x in rows], "g string, id int, x double, y double")
    named, got = A.neighbours(df, ["id"], ["x", "y"], ["g"], 4, 5, 2)
    ids = {r._rid: r.id for r in named.collect()}
    near = _plain(rows, 4)
    assert {ids[r.a]: [ids[p.b] for p in r.near] for r in got.collect()} == {i: [b for _, b in n] for (_, i), n in near.items()}
    assert {ids[r.a] for r in got.collect() if r.kd is None} == {3}
