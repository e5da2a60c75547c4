"""Centroid clustering: the walk against all distances, the operator against plain rounds, odd cases."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockyard.llm import centroids as C


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 6), st.integers(0, 4), st.integers(0, 2**32 - 1))
def test_walk_is_exact(k, dim, spread, seed):
    """Small ranges make ties between values, centroids and distances common."""
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-spread, spread + 1, (k, dim)), rng.integers(-spread - 2, spread + 3, (40, dim))
    who, far = C.Walk(c.tolist()).nearest(x)
    all_ = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (who == all_.argmin(1)).all() and (far == all_.min(1)).all()


def test_walk_over_several_blocks_and_large_values(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    rng = np.random.default_rng(3)
    c, x = rng.integers(-C.LARGEST, C.LARGEST + 1, (16, 64)), rng.integers(-C.LARGEST, C.LARGEST + 1, (50, 64))
    who, far = C.Walk(c.tolist()).nearest(x)
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    assert who.tolist() == [p.index(min(p)) for p in plain] and far.tolist() == [min(p) for p in plain]


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * float(a)) for a in v]) for i, v in rows if v is not None and len(v) == dim and all(a is not None and math.isfinite(a) for a in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= C.LARGEST]
    now = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        who = [near(v)[1] for _, v in kept]
        for n in set(who):
            mine = [v for (_, v), w in zip(kept, who, strict=True) if w == n]
            now[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(r[2] for r in out)
    return [(i, n, d, sum(r[2] for r in out if r[1] == n), total, hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for i, n, d in out]


SCHEMA = "`vec.id` bigint, embedding array<float>, cluster string, inertia int, `a b` int"


def run(spark, rows, **args):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in C.clustered(df, "vec.id", **args).collect()]


@pytest.mark.parametrize("k", [1, 4, 30])
def test_operator_against_plain_rounds(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(i) if i else None, [float(a) for a in rng.normal(0, 0.1, 5).astype(np.float32)]) for i in rng.integers(0, 25, 60)] * 2
    rows += [(1, None), (2, []), (3, [0.0] * 4), (4, [None, 0.0, 0.0, 0.0, 0.0]), (5, [float("nan")] * 5), (6, [float("inf")] * 5), (7, [0.0] * 6)]
    told = lambda rows: sorted(rows, key=str)
    assert told(run(spark, rows, k=k, dim=5)) == told(plain(rows, k, 3, 5))


def test_values_too_large_stay_outside(spark):
    got = {r[0]: r[1:] for r in run(spark, [(1, [1e30, 0.0]), (2, [0.5, -0.01])], dim=2)}
    assert got[1] == (None,) * 5 and got[2][:4] == (0, 0, 0, 0) and got[2][4] == hashlib.sha256(b"32,-1").hexdigest()


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
