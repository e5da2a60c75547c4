"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm.

Each dimension has its centroids sorted by their value. From a vector's own value one walks outwards in every dimension at once, the
nearer side first. A centroid met for the first time gets its exact distance; the squares of the last steps' distances, summed over the
dimensions, bound the distance of every centroid not met yet from below. The walk ends when that sum strictly exceeds the best exact
distance (an equal sum may hide a smaller number at the same distance) or when all centroids are met.

Spark deals out the vectors; a task gets the centroids (k x dim integers, whatever the data) with its code and gives k rows of sums,
so a step shuffles k rows a task. Sums and distances are exact integers.

Kept are vectors of exactly `dim` components, none null, NaN or infinite. A kept vector with a scaled component over LARGEST in size (its
squared distance may not fit a long) takes part in nothing and comes back with a null cluster. Null ids hash as an empty string; repeated ids and
repeated vectors are vectors of their own; equal hashes go by the vectors' components. Fewer kept vectors than k give as many centroids.
No kept vector gives no row. Only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import common as C

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
LARGEST = 1 << 27
#: Vectors that are walked together, whatever the batch.
BLOCK = 2048


def scaled(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are kept, their integer vectors, which of them have no component over LARGEST)."""
    column = column.cast(pa.large_list(pa.float64()))
    none = np.zeros(0, np.int64), np.zeros((0, dim), np.int64), np.zeros(0, bool)
    if not len(column):
        return none
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return none
    flat = column.take(pa.array(rows)).flatten()
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        y = np.floor(scale * x[good])
    fits = (np.abs(y) <= LARGEST).all(axis=1)
    return rows[good], np.where(fits[:, None], y, 0).astype(np.int64), fits


class Walk:
    """The sorted lists of some centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        self.k, self.dim = self.c.shape
        self.order = np.argsort(self.c, axis=0, kind="stable").T.copy()  # by dimension: centroid numbers by value
        # A bound at either end, farther than any value: the walk never takes it before the others.
        wall = np.full((self.dim, 1), 1 << 40)
        self.values = np.hstack([-wall, np.take_along_axis(self.c, self.order.T, 0).T, wall])
        self.numbers = np.hstack([np.zeros((self.dim, 1), np.int64), self.order, np.zeros((self.dim, 1), np.int64)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector (the smallest of equally near ones), and the squared distance."""
        who, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            who[at : at + BLOCK], far[at : at + BLOCK] = self._block(x[at : at + BLOCK])
        return who, far

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = len(x), np.arange(self.dim)
        # The first list entry at or above the value, in every dimension.
        right = np.stack([np.searchsorted(self.values[j], x[:, j]) for j in range(self.dim)], axis=1)
        left = right - 1
        none = np.iinfo(np.int64).max
        exact = np.full((n, self.k), none)
        open_ = np.arange(n)
        for _ in range(self.k):
            v, lo, hi = x[open_], left[open_], right[open_]
            down, up = v - self.values[dims, lo], self.values[dims, hi] - v
            take_up = up < down
            number = np.where(take_up, self.numbers[dims, hi], self.numbers[dims, lo])
            step = np.where(take_up, up, down)
            left[open_], right[open_] = lo - ~take_up, hi + take_up
            met = np.zeros((len(open_), self.k), bool)
            met[np.arange(len(open_))[:, None], number] = True
            row, c = np.nonzero(met & (exact[open_] == none))
            exact[open_[row], c] = np.square(x[open_[row]] - self.c[c]).sum(axis=1)
            frontier = np.square(step).sum(axis=1)
            best = exact[open_].min(axis=1)
            open_ = open_[(frontier <= best) & (exact[open_] == none).any(axis=1)]
            if not len(open_):
                break
        who = exact.argmin(axis=1)  # the first of equals
        return who, exact[np.arange(n), who]


def _first(vectors: DataFrame, k: int, dim: int, scale: int) -> list[list[int]]:
    """The k kept vectors whose ids hash lowest: each task keeps k, and k of those stay."""

    def lowest(batches):
        best: list[tuple[str, list[int]]] = []
        for b in batches:
            rows, x, fits = scaled(b.column(1), dim, scale)
            ids = b.column(0).take(pa.array(rows[fits])).to_pylist()
            best += [(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in zip(ids, x[fits].tolist(), strict=True)]
            best = sorted(best)[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["h", "v"])

    return [r["v"] for r in vectors.mapInArrow(lowest, "h string, v array<bigint>").orderBy("h", "v").limit(k).collect()]


def _sums(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list:
    """(cluster, n, sums by dimension) of all vectors at their nearest centroids: k rows."""

    def partial(batches):
        walk = Walk(centroids)
        n, total = np.zeros(walk.k, np.int64), np.zeros((walk.k, dim), np.int64)
        for b in batches:
            _, x, fits = scaled(b.column(1), dim, scale)
            who, _ = walk.nearest(x[fits])
            n += np.bincount(who, minlength=walk.k)
            np.add.at(total, who, x[fits])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(total[some, j]) for j in range(dim))], ["cluster", "n", *(f"s{j}" for j in range(dim))])

    rows = vectors.mapInArrow(partial, "cluster bigint, n bigint, " + ", ".join(f"s{j} bigint" for j in range(dim)))
    exact = [F.sum(F.col(f"s{j}").cast("decimal(28,0)")).alias(f"s{j}") for j in range(dim)]
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()


def centroids_of(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> list[list[int]]:
    """The centroids after `rounds` steps from the first ones; vectors is (id, array)."""
    now = _first(vectors, k, dim, scale)
    for _ in range(rounds if now else 0):
        for r in _sums(vectors, now, dim, scale):
            now[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]  # whole numbers: the floor is exact
    return now


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector of df."""
    spark = df.sparkSession
    C.bounded_batches(spark, BLOCK)
    vectors = df.select(C.col(id_col).alias("id"), C.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(vectors.dtypes)["id"]
    now = centroids_of(vectors, k, rounds, dim, scale)

    def assign(batches):
        walk = Walk(now) if now else None
        for b in batches:
            rows, x, fits = scaled(b.column(1), dim, scale)
            who, far = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            if walk:
                who[fits], far[fits] = walk.nearest(x[fits])
            out = ~fits
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(who.astype(np.int32), mask=out), pa.array(far, mask=out)], ["id", "cluster", "distance"])

    # Written once: the inertias and the rows are read from it.
    found, _ = C.written(vectors.mapInArrow(assign, f"id {kind}, cluster int, distance bigint"), "clustered")
    names = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(now)], "cluster int, centroid_sha256 string")
    by = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("t"))  # k rows
    whole = by.agg(F.sum("t").alias("all"))
    by = by.join(names, "cluster").crossJoin(F.broadcast(whole))  # k rows by one
    by = by.select("cluster", F.expr("try_cast(t AS bigint)").alias("cluster_inertia"), F.expr("try_cast(`all` AS bigint)").alias("inertia"), "centroid_sha256")
    out = found.join(F.broadcast(by), "cluster", "left")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(C.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Plain rounds: every vector against every centroid."""
    near = """n{0} AS (SELECT r, c, d FROM (SELECT k.r, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, m{0} m)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    step = """s{0} AS (SELECT n.c, j, CAST(floor_div(sum(k.v[j]), count(*)) AS BIGINT) AS x FROM n{0} n JOIN k USING (r), range(1, 65) t(j) GROUP BY n.c, j),
m{1} AS (SELECT m.c, coalesce(w.v, m.v) AS v FROM m{0} m LEFT JOIN (SELECT c, list(x ORDER BY j) AS v FROM s{0} GROUP BY c) w ON m.c = w.c)"""
    # Floored division of whole numbers; DuckDB's // truncates.
    step = step.replace("floor_div(sum(k.v[j]), count(*))", "(sum(k.v[j]) - ((sum(k.v[j]) % count(*)) + count(*)) % count(*)) // count(*)")
    rounds = ",\n".join(near.format(i) + ",\n" + step.format(i, i + 1) for i in range(ROUNDS))
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
m0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM k ORDER BY h, v LIMIT {K})),
{rounds},
{near.format(ROUNDS)}
SELECT k.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN k USING (r) JOIN m{ROUNDS} m ON n.c = m.c
"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLE_SQL = {"op12_centroids": _oracle()}
