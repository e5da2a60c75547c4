"""Pick sessions, routes and slotting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.running import running

DEPOT = (0.0, 0.0, 1.0)


def pick_sessions(lines: DataFrame, least: int = 5, most: int = 15) -> DataFrame:
    """session, skus: sessions with that many distinct skus. A session too large for the range is counted, not collected."""
    each = lines.select("session", "sku").distinct()
    fit = each.groupBy("session").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most)).select("session")
    return each.join(fit, "session", "left_semi").groupBy("session").agg(F.array_sort(F.collect_set("sku")).alias("skus"))


def grid_position(sku: Column) -> Column:
    """struct(x, y, z) of a part's slot."""
    return F.struct((sku % 22).cast("double").alias("x"), (F.floor(sku / 22) % 20).cast("double").alias("y"), (1 + sku % 5).cast("double").alias("z"))


def distance(a: Column, b: Column) -> Column:
    """Floor distance, and twice the difference in level."""
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) + 2 * F.abs(a["z"] - b["z"])


def path_length(stops: Column, depot=DEPOT) -> Column:
    """Length of the open path from the depot through an array of struct(x, y, z), in order."""
    start = F.struct(*[F.lit(v).alias(n) for n, v in zip("xyz", depot, strict=True)])
    step = lambda s, p: F.struct((s["d"] + distance(s["at"], p)).alias("d"), p.alias("at"))
    return F.aggregate(stops, F.struct(F.lit(0.0).alias("d"), start.alias("at")), step, lambda s: s["d"])


# Sequential searches: one session at a time, whole batches of sessions per call


def _matrix(p: np.ndarray, depot) -> np.ndarray:
    q = np.vstack([np.asarray(depot, float), p])
    return np.sqrt(((q[:, None, :2] - q[None, :, :2]) ** 2).sum(2)) + 2 * np.abs(q[:, None, 2] - q[None, :, 2])


def _length(m, order: list[int]) -> float:
    return float(sum(m[a][b] for a, b in zip([0, *order], order, strict=False)))


def nearest_neighbour(m) -> list[int]:
    """Always to the nearest stop left, the first of equals. Stops are 1 .. n, the depot 0; m is any indexable matrix."""
    left, at, out = list(range(1, len(m))), 0, []
    while left:
        row = m[at]
        at = min(left, key=row.__getitem__)
        left.remove(at)
        out.append(at)
    return out


def two_opt(m, order: list[int], sweeps: int = 100, eps: float = 1e-10) -> list[int]:
    """Reverse any stretch after the first stop that shortens the path, first improvement first, until none does."""
    order = list(order)
    n = len(order)
    for _ in range(sweeps):
        better = False
        for i in range(1, n - 1):
            before = m[order[i - 1]]
            for j in range(i + 1, n):
                first, last = order[i], order[j]
                change = before[last] - before[first]
                if j + 1 < n:
                    change += m[first][order[j + 1]] - m[last][order[j + 1]]
                if change < -eps:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return order


def exact_lengths(ms: np.ndarray) -> np.ndarray:
    """The shortest open paths of many sessions with equally many stops, by one dynamic program over sets of stops for all of them.

    ms: (sessions, n + 1, n + 1). best[set, last] is the shortest way through a set that ends at last.
    """
    b, n = len(ms), ms.shape[1] - 1
    if not n:
        return np.zeros(b)
    best = np.full((1 << n, n, b), np.inf)
    step = ms[:, 1:, 1:].transpose(1, 2, 0)
    for j in range(n):
        best[1 << j, j] = ms[:, 0, j + 1]
    for s in range(1, 1 << n):
        inside = [j for j in range(n) if s >> j & 1]
        for k in range(n):
            if not s >> k & 1:
                np.minimum(best[s | 1 << k, k], (best[s, inside] + step[inside, k]).min(0), out=best[s | 1 << k, k])
    return best[-1].min(0)


def exact_length(m: np.ndarray) -> float:
    return float(exact_lengths(np.asarray(m, float)[None])[0])


def routes(sessions: DataFrame, exact_most: int = 8, depot=DEPOT) -> DataFrame:
    """session, n_stops, naive, nearest, two_opt, exact (null beyond exact_most stops) for sessions (session, stops: array of struct x, y, z)."""

    def solve(batches):
        for b in batches:
            ms = [_matrix(np.column_stack([x, y, z]).astype(float), depot) for x, y, z in zip(b["x"], b["y"], b["z"], strict=True)]
            exact: list[float | None] = [None] * len(ms)
            by_size: dict[int, list[int]] = {}
            for i, m in enumerate(ms):
                if len(m) - 1 <= exact_most:
                    by_size.setdefault(len(m), []).append(i)
            for at in by_size.values():
                for lo in range(0, len(at), 2000):
                    part = at[lo : lo + 2000]
                    for i, d in zip(part, exact_lengths(np.stack([ms[i] for i in part])), strict=True):
                        exact[i] = float(d)
            out = []
            for s, m, e in zip(b["session"], ms, exact, strict=True):
                rows = m.tolist()
                nn = nearest_neighbour(rows)
                out.append((s, len(rows) - 1, _length(rows, list(range(1, len(rows)))), _length(rows, nn), _length(rows, two_opt(rows, nn)), e))
            yield pd.DataFrame(out, columns=["session", "n_stops", "naive", "nearest", "two_opt", "exact"])

    flat = sessions.select("session", *[F.col(f"stops.{c}").alias(c) for c in "xyz"])
    return flat.mapInPandas(solve, "session bigint, n_stops int, naive double, nearest double, two_opt double, exact double")


def route_gaps(r: DataFrame) -> DataFrame:
    """method, mean_distance, median_distance, mean_reduction_pct (of each session against naive), mean_gap_pct (to exact)."""
    long = r.select("session", "naive", "exact", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("d")) for m in ("naive", "nearest", "two_opt")])).alias("x")).select("naive", "exact", "x.*")
    return long.groupBy("method").agg(F.avg("d").alias("mean_distance"), F.median("d").alias("median_distance"), F.avg(100 * (F.col("naive") - F.col("d")) / F.col("naive")).alias("mean_reduction_pct"), F.avg(100 * (F.col("d") - F.col("exact")) / F.col("exact")).alias("mean_gap_pct"))


# Slotting


def cyclic_assignment(items: DataFrame, slots: DataFrame, item_order: list[Column], slot_order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The i-th item to slot i mod n, within each group of `by`: two row numbers and an equi-join."""
    w = Window.partitionBy(*(by or []))
    i = items.withColumn("_i", F.row_number().over(w.orderBy(*item_order)) - 1)
    s = slots.withColumn("_s", F.row_number().over(w.orderBy(*slot_order)) - 1).withColumn("_n", F.count("*").over(w))
    size = slots.groupBy(*(by or [])).agg(F.count("*").alias("_n"))
    i = (i.join(size, by) if by else i.join(F.broadcast(size))).withColumn("_s", F.col("_i") % F.col("_n"))
    return i.join(s.drop("_n"), [*(by or []), "_s"]).drop("_i", "_s", "_n")


def depot_distance(x: Column, y: Column) -> Column:
    return F.abs(x - 4.5) + 0.1 * y


def greedy_zones(skus: DataFrame, zones: list[tuple[str, int]], order: list[Column]) -> DataFrame:
    """zone of each sku: the most picked to the first zone until it is full, then the next; the last zone takes the rest."""
    out, to = None, 0
    for name, room in zones[:-1]:
        to += room
        out = F.when(F.col("_r") <= to, name) if out is None else out.when(F.col("_r") <= to, name)
    return running(skus, order, number="_r").withColumn("zone", out.otherwise(zones[-1][0]) if out is not None else F.lit(zones[-1][0])).drop("_r")


def joint_then_greedy(skus: DataFrame, at: dict[int, str], zones: list[tuple[str, int]], order: list[Column]) -> DataFrame:
    """zone of each sku: where the joint plan `at` puts it; all other skus greedily into the room that is left (the last zone takes the rest)."""
    plan = skus.sparkSession.createDataFrame(list(at.items()), f"sku {dict(skus.dtypes)['sku']}, zone string")
    taken = list(at.values())
    rest = greedy_zones(skus.join(F.broadcast(plan), "sku", "left_anti"), [(z, n - taken.count(z)) for z, n in zones], order)
    return skus.join(F.broadcast(plan), "sku").unionByName(rest)


def joint_zones(items: list[tuple[int, float]], pairs: list[tuple[int, int, float]], zones: list[tuple[str, int, float]], bonus: float = 0.5) -> tuple[dict[int, str], float, float]:
    """Zones that minimise sum of distance x picks less bonus x lift of pairs in one zone, under capacities, for a stated few items.

    Returns the assignment, its objective and a lower bound. Without binding capacities all in the nearest zone is optimal and meets the
    bound; else a greedy start and moves and swaps until none helps. items: (id, picks); zones: (name, capacity, distance).
    """
    near = sorted(zones, key=lambda z: z[2])
    cost = {z[0]: z[2] for z in zones}
    room = {z[0]: z[1] for z in zones}
    picks = dict(items)
    friends: dict[int, list[tuple[int, float]]] = {i: [] for i in picks}
    for a, b, lift in pairs:
        if a in friends and b in friends:
            friends[a].append((b, lift))
            friends[b].append((a, lift))
    at: dict[int, str] = {}
    for i, _ in sorted(items, key=lambda x: (-x[1], x[0])):
        z = next(z[0] for z in near if room[z[0]] > 0)
        at[i], room[z] = z, room[z] - 1
    gain = lambda i, z, skip=None: cost[z] * picks[i] - bonus * sum(v for j, v in friends[i] if j != skip and at[j] == z)
    better = True
    while better:
        better = False
        for i in sorted(picks):
            for z in (z[0] for z in near):
                if z != at[i] and room[z] > 0 and gain(i, z) < gain(i, at[i]) - 1e-9:
                    room[at[i]], room[z], at[i], better = room[at[i]] + 1, room[z] - 1, z, True
            for j in sorted(picks):
                if i < j and at[i] != at[j]:
                    before = gain(i, at[i]) + gain(j, at[j])
                    at[i], at[j] = at[j], at[i]
                    if gain(i, at[i]) + gain(j, at[j]) < before - 1e-9:
                        better = True
                    else:
                        at[i], at[j] = at[j], at[i]
    value = sum(cost[at[i]] * p for i, p in items) - bonus * sum(v for a, b, v in pairs if a in at and b in at and at[a] == at[b])
    bound, left = 0.0, [(z[2], z[1]) for z in near]
    for _, p in sorted(items, key=lambda x: -x[1]):
        while left and left[0][1] == 0:
            left.pop(0)
        bound += left[0][0] * p
        left[0] = (left[0][0], left[0][1] - 1)
    return at, value, bound - bonus * sum(v for a, b, v in pairs if a in at and b in at)
