"""K-Means from many starts, of several k and feature sets at once.

All starts advance together: a step sends every start's centres with the task's code (starts x k x features numbers, whatever the data), each task
gives sums by (start, cluster), and one aggregate adds them up. So 50 starts of one k, a sweep over k, or an ablation cost the steps of
the slowest start, and every step reads the points once. A start that has come to rest takes no further part. Equal points are one, with a weight.

Starts are seeded by greedy k-means++: a round draws several candidates for each start, with chances in proportion to the squared
distance from the centres so far, and keeps the one that leaves the least. A draw is a race: every point gets an exponential time from
a hash of its key, the start and the round, divided by its weight (equal points share the least hash and add their weights), and the earliest win; so draws depend on the data only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.sources.files import scratch


@dataclass(frozen=True)
class Fit:
    """The best of `starts` starts with k centres, on the features but those of `without`. Fits of one seed and feature set share their draws."""

    name: str
    k: int
    starts: int = 20
    seed: int = 0
    without: tuple[str, ...] = ()


def stored(points: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, h, x) as a written table: h a hash of the key, x the features."""
    path = scratch(points.sparkSession, "points")
    rows = points.select(F.col(key), F.xxhash64(F.col(key)).alias("h"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    # Dealt out evenly: a step is work, not bytes, so what is one file of little data would be one busy task.
    rows.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return points.sparkSession.read.schema(rows.schema).parquet(path)


def _distinct(rows: DataFrame) -> DataFrame:
    """(h, x, n) as a written table: equal points are one, with their number and the least of their hashes."""
    path = scratch(rows.sparkSession, "distinct")
    met = rows.groupBy("x").agg(F.min("h").alias("h"), F.count("*").alias("n")).select("h", "x", "n")
    met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return rows.sparkSession.read.schema(met.schema).parquet(path)


def _arrays(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, points, and how many each stands for (1 without a column n)."""
    h, x = batch.column("h").to_numpy(zero_copy_only=False), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return h, x, batch.column("n").to_numpy().astype(np.float64) if "n" in batch.schema.names else np.ones(len(h))


def _uniform(h: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes, a seed and a round."""
    x = h.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64)
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _squared(x: np.ndarray, centres: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres over the features of mask."""
    out = np.zeros((len(centres), len(x)))
    for f in np.flatnonzero(mask):
        gap = x[:, f] - centres[:, f, None]
        out += np.multiply(gap, gap, out=gap)
    return out.T


def _nearest(x: np.ndarray, centres: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The nearest centre of each point: the least of |c|^2 - 2 x c, which leaves |x|^2 out."""
    c = centres * mask
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def _seeded(points: DataFrame, d: int, draws: list[tuple[int, np.ndarray, int]]) -> list[np.ndarray]:
    """For each (seed, mask, k): k centres by greedy k-means++."""
    centres: list[np.ndarray] = [np.zeros((0, d)) for _ in draws]
    for turn in range(max(k for *_, k in draws)):
        live = [i for i, (*_, k) in enumerate(draws) if turn < k]
        tries = {i: 1 if turn == 0 else 2 + int(math.log(draws[i][2])) for i in live}

        def races(batches, turn=turn, live=live, tries=tries):
            best: dict[int, list] = {i: [] for i in live}
            for b in batches:
                h, x, n = _arrays(b, d)
                if not len(h):
                    continue
                for i in live:
                    seed, mask, _ = draws[i]
                    weight = n * _squared(x, centres[i], mask).min(axis=1) if turn else n
                    with np.errstate(divide="ignore"):
                        time = np.where(weight > 0, -np.log(_uniform(h, seed, turn)) / weight, np.inf)
                    # Points on a centre come last: they are drawn where nothing else is left.
                    first = np.lexsort((h, time))[: tries[i]]
                    best[i] = sorted(best[i] + [(float(time[j]), int(h[j]), x[j].tolist()) for j in first])[: tries[i]]
            rows = [(i, *r) for i in live for r in best[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.float64()))], ["i", "time", "h", "x"])

        most = max(tries.values())
        drawn = points.mapInArrow(races, "i int, time double, h bigint, x array<double>").groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("time", "h", "x"))), 1, most).alias("c"))
        found = {r["i"]: np.array([c["x"] for c in r["c"][: tries[r["i"]]]]) for r in drawn.collect()}
        if turn == 0:
            for i in live:
                centres[i] = found[i]
            continue

        def left(batches, live=live, found=found):
            total = {i: np.zeros(len(found[i])) for i in live}
            for b in batches:
                _, x, n = _arrays(b, d)
                if len(x):
                    for i in live:
                        mask = draws[i][1]
                        now = _squared(x, centres[i], mask).min(axis=1)
                        total[i] += n @ np.minimum(now[:, None], _squared(x, found[i], mask))
            rows = [(i, c, v) for i in live for c, v in enumerate(total[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([float(r[2]) for r in rows], pa.float64())], ["i", "c", "v"])

        sums = points.mapInArrow(left, "i int, c int, v double").groupBy("i", "c").agg(F.sum("v").alias("v"))
        for r in sums.groupBy("i").agg(F.min_by("c", F.struct("v", "c")).alias("c")).collect():
            centres[r["i"]] = np.vstack([centres[r["i"]], found[r["i"]][r["c"]]])
    return centres


def _step(points: DataFrame, d: int, now: dict[int, np.ndarray], masks: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """For each start: the means of its clusters (an empty one stays where it is) and the inertia at the centres it had."""

    # Starts of one k side by side, so that a batch meets all centres in one product and each k in a few operations.
    order = sorted(now, key=lambda i: (len(now[i]), i))
    sizes = [(k, len([*same])) for k, same in groupby(order, key=lambda i: len(now[i]))]
    who_of = [(i, c) for i in order for c in range(len(now[i]))]
    left = np.vstack([np.column_stack([-2 * now[i] * masks[i], ((now[i] * masks[i]) ** 2).sum(axis=1)]) for i in order])
    shown = np.array([masks[i] for i in order], np.float64)

    def partial(batches, tile=256):
        total = np.zeros((len(left), d + 1))  # sums of the points, and how many
        cost = np.zeros(len(order))
        for b in batches:
            _, every, weights = _arrays(b, d)
            for at in range(0, len(every), tile):
                x, w = every[at : at + tile], weights[at : at + tile]
                far = left @ np.column_stack([x, np.ones(len(x))]).T  # |c|^2 - 2 x c
                own = shown @ (x**2).T
                given = np.column_stack([x * w[:, None], w])
                row = start = 0
                for k, many in sizes:
                    f = far[row : row + k * many].reshape(many, k, -1)
                    least = f.min(axis=1)
                    mine = f == least[:, None]
                    if np.count_nonzero(mine) != least.size:  # equal centres: the first has the point
                        mine = f.argmin(axis=1)[:, None] == np.arange(k)[:, None]
                    total[row : row + k * many] += mine.reshape(k * many, -1).astype(np.float64) @ given
                    cost[start : start + many] += np.maximum(0.0, least + own[start : start + many]) @ w
                    row, start = row + k * many, start + many
        at = np.flatnonzero(total[:, d])
        first = {i: n for n, (i, _) in reversed([*enumerate(who_of)])}
        paid = np.zeros(len(left))
        paid[[first[i] for i in order]] = cost
        at = np.union1d(at, np.flatnonzero(paid)).astype(int)
        columns = [pa.array([who_of[r][0] for r in at], pa.int32()), pa.array([who_of[r][1] for r in at], pa.int32()), pa.array(total[at, d]), pa.array(paid[at]), *(pa.array(total[at, f]) for f in range(d))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "c", "n", "cost", *(f"s{f}" for f in range(d))])

    sums = points.mapInArrow(partial, "i int, c int, n double, cost double, " + ", ".join(f"s{f} double" for f in range(d))).groupBy("i", "c").agg(*[F.sum(c).alias(c) for c in ["n", "cost", *(f"s{f}" for f in range(d))]])
    out = {i: (c.copy(), 0.0) for i, c in now.items()}
    for r in sums.collect():  # starts x k rows
        means, cost = out[r["i"]]
        if r["n"]:
            means[r["c"]] = [r[f"s{f}"] / r["n"] for f in range(d)]
        out[r["i"]] = means, cost + r["cost"]
    return out


def fit_all(points: DataFrame, key: str, features: list[str], fits: list[Fit], max_iter: int = 500, tol: float = 1e-4, keep: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """(key, fit, cluster) for every fit, and each fit's inertia; `keep`: with the features behind them.

    A start rests once its centres move by no more than tol times the mean variance of the features (squared, in all). Rows with a null
    or NaN feature are left out. More centres than distinct points leave some clusters empty; no point gives no row.
    """
    complete = points
    for c in features:
        complete = complete.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    rows, d = stored(complete, key, features), len(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name == key) + ", fit string, cluster int" + "".join(f", `{c}` double" for c in features if keep)
    spread = rows.agg(F.count("*").alias("n"), *[F.var_pop(F.col("x")[f]).alias(f"v{f}") for f in range(d)]).first()
    if not spread["n"]:
        return rows.sparkSession.createDataFrame([], schema), {f.name: 0.0 for f in fits}
    met = _distinct(rows)
    masks = [np.array([c not in f.without for c in features]) for f in fits]
    # Fits of one seed and feature set draw once, for the largest k.
    wanted: dict[tuple, int] = {}
    for f, m in zip(fits, masks, strict=True):
        for s in range(f.starts):
            wanted[f.seed + s, tuple(m)] = max(f.k, wanted.get((f.seed + s, tuple(m)), 0))
    drawn = dict(zip(wanted, _seeded(met, d, [(s, np.array(m), k) for (s, m), k in wanted.items()]), strict=True))
    starts = [(n, drawn[f.seed + s, tuple(m)][: f.k]) for n, (f, m) in enumerate(zip(fits, masks, strict=True)) for s in range(f.starts)]
    of = {i: n for i, (n, _) in enumerate(starts)}
    mask_of = {i: masks[n] for i, n in of.items()}
    now, live = {i: c for i, (_, c) in enumerate(starts)}, set(range(len(starts)))
    limit = {n: tol * float(np.mean([spread[f"v{f}"] for f in np.flatnonzero(m)])) for n, m in enumerate(masks)}
    for _ in range(max_iter):
        for i, (means, _) in _step(met, d, {i: now[i] for i in live}, mask_of).items():
            moved = float(((means - now[i])[:, mask_of[i]] ** 2).sum())
            now[i] = means
            if moved <= limit[of[i]]:
                live.discard(i)
        if not live:
            break
    cost = {i: c for i, (_, c) in _step(met, d, now, mask_of).items()}
    best = {f.name: min((i for i in of if of[i] == n), key=lambda i: (cost[i], i)) for n, f in enumerate(fits)}

    def labels(batches):
        for b in batches:
            _, x, _ = _arrays(b, d)
            who = [_nearest(x, now[i], mask_of[i]).astype(np.int32) for i in best.values()]
            flat = np.column_stack(who).ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("x"), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(who), np.int32), pa.array(flat))], [key, "x", "clusters"])

    # One row a point, with its cluster in each fit; they are rows of their own only when read.
    path = scratch(rows.sparkSession, "labels")
    wide = rows.mapInArrow(labels, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name == key) + ", x array<double>, clusters array<int>")
    wide.write.parquet(path)
    long = rows.sparkSession.read.schema(wide.schema).parquet(path).select(key, "x", F.posexplode("clusters").alias("_fit", "cluster"))
    names = F.array(*map(F.lit, best))
    return long.select(key, names[F.col("_fit")].alias("fit"), "cluster", *[F.col("x")[f].alias(c) for f, c in enumerate(features) if keep]), {name: cost[i] for name, i in best.items()}
