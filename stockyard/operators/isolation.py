"""Isolation Forest with samples from all rows and trees grown in tasks.

Tree t's sample is the rows with the least hash(key, seed, t), so each row of a group has the same chance and the forest depends on the data only. A
count sets a threshold that some more than `sample` rows of each tree pass (fewer with a chance below e^-40; the tree then takes those); only they are
shuffled: trees x sample rows a group, whatever its size. Each (group, tree) is one task's call.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARRAYS = ("feature", "cut", "left", "right", "depth")
_TREE = "_n bigint, tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def path_constant(n: float) -> float:
    """The mean depth at which a search among n rows fails."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, g: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree over all rows of x as flat arrays: feature (-1 at leaves), cut, left, right, depth added at leaves."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    feature, cut, left, right, depth = nodes = ([], [], [], [], [])

    def node(rows: np.ndarray, d: int) -> int:
        i = len(feature)
        for a in nodes:
            a.append(0)
        lo, hi = rows.min(0), rows.max(0)
        wide = np.flatnonzero(hi > lo)
        if d >= limit or len(rows) <= 1 or not len(wide):
            feature[i], depth[i] = -1, d + path_constant(len(rows))
            return i
        f = int(g.choice(wide))
        c = float(g.uniform(lo[f], hi[f]))
        below = rows[:, f] <= c
        feature[i], cut[i] = f, c
        left[i], right[i] = node(rows[below], d + 1), node(rows[~below], d + 1)
        return i

    node(x, 0)
    return tuple(map(np.array, nodes))


def forest_scores(forest: list[tuple], x: np.ndarray, sample: int) -> np.ndarray:
    """Higher is more unusual, about 0.5 for the usual."""
    total = np.zeros(len(x))
    for feature, cut, left, right, depth in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            go = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
            at = np.where(inner, go, at)
        total += depth[at]
    return 2.0 ** (-total / len(forest) / max(path_constant(sample), 1e-9))


def _usable(df: DataFrame, key: list[str], features: list[str], seed: int, by: list[str]) -> DataFrame:
    """Rows whose features are all numbers, with `_h`, a hash of key and seed, and features as `_x`."""
    x = [F.col(c).cast("double") for c in features]
    fine = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf) for c in x]
    kept = df
    for c in fine:
        kept = kept.filter(c)
    return kept.select(*dict.fromkeys([*by, *key]), F.xxhash64(*key, F.lit(seed)).alias("_h"), F.array(*x).alias("_x"))


def grown(rows: DataFrame, counts: DataFrame, by: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """by, _n, tree and its arrays, from rows (by, _h, _x) and counts (by, _n)."""
    reach = sample + 12 * math.sqrt(sample) + 60
    each = rows.select(*by, "_h", "_x").join(counts, by) if by else rows.select("_h", "_x").join(F.broadcast(counts))
    limit = F.least(F.lit(1.0), F.lit(reach) / F.col("_n")) * 2.0**64 - 2.0**63
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("_h", t).alias("u")))
    taken = each.select(*by, "_n", "_x", F.explode(F.filter(draws, lambda s: s["u"].cast("double") <= limit)).alias("_s")).select(*by, "_n", "_x", "_s.*")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        chosen = sorted(zip(pdf["u"], map(tuple, pdf["_x"]), strict=True))[:sample]
        tree = grow_tree(np.array([x for _, x in chosen], float), np.random.default_rng([seed, t]))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in [*by, "_n"]), t, *(a.tolist() for a in tree)]], columns=[*by, "_n", "tree", *_ARRAYS])

    schema = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes) + _TREE
    # A number of partitions of its own: a tree is work, not bytes.
    n = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartition(n, *by, "tree").groupBy(*by, "tree").applyInPandas(grow, schema)


def _forest(pdf: pd.DataFrame) -> list[tuple]:
    return [tuple(np.array(a) for a in r) for r in pdf.sort_values("tree")[list(_ARRAYS)].itertuples(index=False)]


def _keys_schema(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{c}` {t}, " for c, t in df.select(*cols).dtypes) + "score double"


def scores(df: DataFrame, key: list[str], features: list[str], train: DataFrame | None = None, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """key, score of every row of df whose features are all finite numbers, by a forest over samples of all rows of `train` (df if None).

    The forest goes to the driver and with the tasks' code: trees x (2 sample - 1) nodes at most, whatever the data. Repeated keys share their
    draws. No rows to learn from: no scores.
    """
    rows = _usable(df if train is None else train, key, features, seed, [])
    target, schema = _usable(df, key, features, seed, []), _keys_schema(df, key)
    found = grown(rows, rows.agg(F.count("*").alias("_n")), [], trees, sample, seed).toPandas()
    if not len(found):
        return target.select(*key, F.lit(None).cast("double").alias("score")).limit(0)
    forest, size = _forest(found), int(min(sample, found["_n"].iloc[0]))

    def score(batches):
        for b in batches:
            out = b[key].copy()
            out["score"] = forest_scores(forest, np.array(b["_x"].tolist(), float).reshape(-1, len(features)), size)
            yield out

    return target.select(*key, "_x").mapInPandas(score, schema)


def scores_by_group(df: DataFrame, key: list[str], features: list[str], by: str, least: int = 20, trees: int = 100, sample: int = 256, seed: int = 42, block: int = 50_000) -> DataFrame:
    """by, key, score: one forest for each group of at least `least` rows with finite features (a null group is none).

    A group's rows are scored in blocks of about `block` by hash, each with a copy of the group's forest, so no group is one task.
    """
    cols = [by, *[c for c in key if c != by]]
    rows = _usable(df, key, features, seed, [by])
    counts = rows.groupBy(by).agg(F.count("*").alias("_n")).filter((F.col("_n") >= least) & F.col(by).isNotNull())
    counts = counts.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    forests = grown(rows, counts.drop("_blocks"), [by], trees, sample, seed).join(counts.drop("_n"), by).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # The low bits of _h say nothing of the draws, which hash it again.
    dealt = rows.join(counts, by).withColumn("_b", F.pmod("_h", "_blocks").cast("int")).select(*cols, "_x", "_b")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[cols].copy()
        if len(left):
            out["score"] = forest_scores(_forest(right), np.array(left["_x"].tolist(), float), int(min(sample, right["_n"].iloc[0])))
        return out.assign(score=out.get("score", pd.Series(dtype=float)))

    return dealt.groupBy(by, "_b").cogroup(forests.drop("_blocks").groupBy(by, "_b")).applyInPandas(score, _keys_schema(df, cols))
