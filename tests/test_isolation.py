"""Isolation forests against a plain version that draws, grows and scores the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.operators import isolation


def _plain(df, features, trees, sample, seed):
    """Scores by key in one place: every tree's sample by sorting all rows."""
    n = df.count()
    draws = df.select("id", F.array(*features).alias("x"), F.xxhash64("id", F.lit(seed)).alias("h"))
    forest = []
    for t in range(trees):
        rows = sorted((r.u, tuple(r.x)) for r in draws.select("x", F.xxhash64("h", F.lit(t)).alias("u")).collect())[:sample]
        forest.append(isolation.grow_tree(np.array([x for _, x in rows]), np.random.default_rng([seed, t])))
    rows = draws.orderBy("id").collect()
    return dict(zip([r.id for r in rows], isolation.forest_scores(forest, np.array([r.x for r in rows]), min(sample, n)), strict=True))


def _rows(spark, n, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    x[-1] = 9
    return spark.createDataFrame([(i, f"g{i % 3}", *map(float, r)) for i, r in enumerate(x)], "id int, g string, a double, b double, c double")


@pytest.mark.parametrize(("n", "sample"), [(900, 32), (150, 256), (900, 256)])
def test_scores_are_the_plain_forests(spark, n, sample):
    df = _rows(spark, n)
    want = _plain(df, ["a", "b", "c"], 8, sample, 5)
    for parts in (1, 7):
        got = {r.id: r.score for r in isolation.scores(df.repartition(parts), ["id"], ["a", "b", "c"], trees=8, sample=sample, seed=5).collect()}
        assert got == pytest.approx(want)


def test_odd_row_has_the_highest_score(spark):
    s = isolation.scores(_rows(spark, 400), ["id"], ["a", "b", "c"], trees=60)
    assert s.orderBy(F.desc("score")).first().id == 399


def test_groups_are_forests_of_their_own_in_any_blocks(spark):
    df = _rows(spark, 300)
    want = {}
    for g in ("g0", "g1", "g2"):
        want |= _plain(df.filter(F.col("g") == g), ["a", "b", "c"], 6, 20, 42)
    for block in (1_000, 17):
        got = isolation.scores_by_group(df, ["id"], ["a", "b", "c"], "g", trees=6, sample=20, block=block)
        assert got.columns == ["g", "id", "score"] and {r.id: r.score for r in got.collect()} == pytest.approx(want)


def test_threshold_leaves_enough_rows(spark):
    """Trees of a large table have full samples though few rows are shuffled."""
    rows = isolation._usable(spark.range(60_000).select("id", F.rand(3).alias("a")), ["id"], ["a"], 1, [])
    trees = isolation.grown(rows, rows.agg(F.count("*").alias("_n")), [], 5, 64, 1).collect()
    assert len(trees) == 5
    for t in trees:
        leaves = sum(f < 0 for f in t.feature)
        assert len(t.feature) == 2 * leaves - 1 and leaves > 20


def test_edges(spark):
    df = _rows(spark, 40)
    odd = df.limit(0).unionByName(spark.createDataFrame([(100, "g0", None, 1.0, 1.0), (101, "g0", float("nan"), 1.0, 1.0), (102, "g0", float("inf"), 1.0, 1.0), (103, None, 1.0, 1.0, 1.0), (104, "small", 1.0, 1.0, 1.0)], df.schema))
    both = df.unionByName(odd)
    assert {r.id for r in isolation.scores(both, ["id"], ["a", "b", "c"], trees=3).collect()} == {*range(40), 103, 104}
    assert {r.id for r in isolation.scores_by_group(both, ["id"], ["a", "b", "c"], "g", least=5, trees=3).collect()} == set(range(40))
    assert isolation.scores(df.limit(0), ["id"], ["a", "b", "c"]).count() == 0
    assert isolation.scores_by_group(df.limit(0), ["id"], ["a", "b", "c"], "g").count() == 0
    same = spark.createDataFrame([(i, 1.0) for i in range(30)], "id int, a double")
    assert len({r.score for r in isolation.scores(same, ["id"], ["a"], trees=3).collect()}) == 1
