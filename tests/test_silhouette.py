import math

import numpy as np

from stockyard.operators.cluster import _distance_sums, silhouette


def _plain(rows):
    out = {}
    whole = [(k, x, g) for k, x, g in rows if g is not None and None not in x]
    for k, x, g in rows:
        out[k] = 0.0
        if (k, x, g) not in whole:
            continue
        means = {}
        for o in {r[2] for r in whole}:
            d = [math.dist(x, y) for j, y, h in whole if h == o and j != k]
            if d:
                means[o] = sum(d) / len(d)
        own, other = means.pop(g, None), min(means.values(), default=None)
        if own is not None and other is not None:
            out[k] = (other - own) / max(own, other) if max(own, other) else math.nan
    return out


def test_all_points_in_blocks(spark):
    """Blocks of any size give what plain loops give: copies, labels of one row, and rows with nulls among them."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) if i % 2 else float(v) for v in rng.normal(size=3) + 1000 * (i % 3)], f"g{i % 4}") for i in range(90)]
    rows += [(100, rows[1][1], "g1"), (101, rows[2][1], "lone"), (102, [0.0, None, 1.0], "g1"), (103, [0.0, 0.0, 1.0], None), (104, [5.0] * 3, "p"), (105, [5.0] * 3, "p")]
    want = _plain(rows)
    df = spark.createDataFrame([(k, *x, g) for k, x, g in rows], "id int, x double, y double, z double, g string").repartition(3)
    for block in (7, 8192):
        got = silhouette(df, "id", ["x", "y", "z"], "g", None, block)
        assert got.columns == ["id", "g", "silhouette"]
        found = {r.id: r.silhouette for r in got.collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-9) for k in want)
    assert silhouette(df.where("id = 1"), "id", ["x"], "g", None).count() == 0


def test_points_of_two_equal_groups_are_nan(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(4)], "id int, x double, g int")
    assert all(math.isnan(r.silhouette) for r in silhouette(df, "id", ["x"], "g", None).collect())


def test_pairs_are_not_made_as_rows(spark):
    """A block meets all points inside a task: the plan has no join."""
    df = spark.range(50).selectExpr("id", "double(id) x", "id % 3 g")
    assert "Join" not in silhouette(df, "id", ["x"], "g", None)._jdf.queryExecution().toString()


def test_near_points_keep_their_distance():
    a = np.array([[1e8, 1.0], [1e8, 1.0 + 1e-6], [0.0, 0.0]])
    assert np.allclose(_distance_sums(a, a, 2), [np.sqrt(((a - x) ** 2).sum(1)).sum() for x in a], rtol=1e-12, atol=0)
