"""K-Means with restarts, cluster quality, choice of k, Ward linkage, PCA, and stability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.segment import agreement
from stockyard.sources.files import scratch


def assembled(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="v").transform(df.select(key, *features)).select(key, "v").cache()


def kmeans(vectors: DataFrame, key: str, k: int, restarts: int = 5, seed: int = 0, max_iter: int = 100) -> tuple[DataFrame, float]:
    """(key, cluster) and the inertia of the best of several seeded starts."""
    fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="v", predictionCol="cluster").fit(vectors) for i in range(restarts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).select(key, "cluster"), best.summary.trainingCost


def quality(points: DataFrame, features: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """k, n, calinski_harabasz, davies_bouldin (one row, or one for each group of by): aggregates of the groups, then of group pairs (k squared, k small)."""
    by = by or []
    g = points.groupBy(*by, label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features])
    j = points.join(F.broadcast(g), [*by, label])
    d2 = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in features), F.lit(0.0))
    s = j.groupBy(*by, label).agg(F.sum(d2).alias("w"), F.avg(F.sqrt(d2)).alias("s"))
    g = g.join(s, [*by, label])
    grand = points.groupBy(*by).agg(*[F.avg(c).alias(f"g_{c}") for c in features])
    b2 = sum(((F.col(f"m_{c}") - F.col(f"g_{c}")) ** 2 for c in features), F.lit(0.0))
    met = lambda a, b: a.join(F.broadcast(b), by) if by else a.join(F.broadcast(b))
    t = met(g, grand).groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * b2).alias("b"))
    o = g.select(*by, F.col(label).alias("l2"), F.col("s").alias("s2"), *[F.col(f"m_{c}").alias(f"o_{c}") for c in features])
    gap = F.sqrt(sum(((F.col(f"m_{c}") - F.col(f"o_{c}")) ** 2 for c in features), F.lit(0.0)))
    db = met(g, o).where(F.col(label) != F.col("l2")).groupBy(*by, label).agg(F.max((F.col("s") + F.col("s2")) / gap).alias("r")).groupBy(*by).agg(F.avg("r").alias("davies_bouldin"))
    return met(t, db).select(*by, "k", "n", ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "davies_bouldin")


def _chunks(batches):
    """mapInArrow: rows (key, label, x) as chunks (label, n, data) of a batch's rows of one label; single precision where that is exact."""
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column("label").dictionary_encode()
        x, of = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), code.indices.to_numpy(zero_copy_only=False)
        parts = [x[of == c] for c in range(len(code.dictionary))]
        with np.errstate(over="ignore"):
            parts = [s if np.array_equal(s := p.astype(np.float32), p) else p for p in parts]
        yield pa.RecordBatch.from_arrays([code.dictionary, pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["label", "n", "data"])


def _distance_sums(a: np.ndarray, b: np.ndarray, tile: int = 512) -> np.ndarray:
    """For each row of a, the sum of its distances to all rows of b. Products of matrices; pairs so near that they would cancel are subtracted instead."""
    out = np.zeros(len(a))
    with np.errstate(invalid="ignore", over="ignore"):
        na, nb = (a**2).sum(axis=1), (b**2).sum(axis=1)
        right = np.column_stack([-2 * b, np.ones(len(b)), nb]).T
        for at in range(0, len(a), tile):
            x, n = a[at : at + tile], na[at : at + tile]
            d = np.column_stack([x, n, np.ones(len(x))]) @ right
            near = np.flatnonzero(~(d.ravel() > 1e-4 * (n.max() + nb.max())))
            for k in range(0, len(near), 65536):
                i, j = np.divmod(near[k : k + 65536], len(b))
                d[i, j] = ((x[i] - b[j]) ** 2).sum(axis=1)
            out[at : at + tile] = np.sqrt(d, out=d).sum(axis=1)
    return out


def silhouette(points: DataFrame, key: str, features: list[str], label: str, most: int | None = 1000, block: int = 8192) -> DataFrame:
    """key, label, silhouette (Euclidean). Every point of a stated sample (`most` by hash of the key, None for all) meets all of it.

    Points are dealt into blocks of about `block` rows. Each block gets all points in chunks, label after label, so a task holds one block
    and one chunk; what is shuffled is blocks x points. Rows with a null in label or features meet nobody and get 0.
    """
    spark = points.sparkSession
    p = points if most is None else points.orderBy(F.xxhash64(key), key).limit(most)
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = p.select(F.col(key).alias("key"), F.col(label).alias("label"), F.when(F.forall(x, lambda v: v.isNotNull()), x).alias("x"))
    path = scratch(spark, "silhouette")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    n = rows.count()
    whole = F.col("label").isNotNull() & F.col("x").isNotNull()
    key_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("key", "label"))
    blocks = max(1, -(-n // block))
    a = rows.where(whole).select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("at"), F.lit(0).alias("kind"), "key", "label", "x", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("data"))
    b = rows.where(whole).mapInArrow(_chunks, f"label {label_type}, n bigint, data binary")
    b = b.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(key_type).alias("key"), "label", F.lit(None).cast("array<double>").alias("x"), "n", "data")
    met = a.unionByName(b).repartitionById(blocks, F.col("at")).sortWithinPartitions("at", "kind", "label")

    def means(batches):
        held: list = []
        at = code = None
        x = labels = own = other = total = seen = None
        count = 0

        def closed():
            """The label at hand is done: its means, to whom it is the own one and to whom another."""
            if not count:
                return
            mine = labels == code
            if count > 1:
                own[mine] = total[mine] / (count - 1)
            other[~mine] = np.fmin(other[~mine], total[~mine] / count)
            seen[~mine] = True

        def rows_of():
            keys, of = pa.concat_arrays([h.column("key") for h in held]), pa.concat_arrays([h.column("label") for h in held])
            alone = np.array([sizes.get(v, 0) < 2 for v in labels.tolist()])
            return pa.RecordBatch.from_arrays([keys, of, pa.array(own, pa.float64(), mask=alone), pa.array(other, pa.float64(), mask=~seen)], ["key", "label", "own", "other"])

        for batch in batches:
            cut = [0, *(np.flatnonzero(np.diff(batch.column("at").to_numpy()) | np.diff(batch.column("kind").to_numpy())) + 1).tolist(), batch.num_rows]
            for i, j in zip(cut, cut[1:]):  # noqa: B905
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                block_at, kind = part.column("at")[0].as_py(), part.column("kind")[0].as_py()
                if block_at != at:
                    if held:
                        closed()
                        yield rows_of()
                    held, at, x, code, count, sizes, codes = [], block_at, None, None, 0, {}, {}
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:
                    x = np.concatenate([h.column("x").flatten().to_numpy(zero_copy_only=False).reshape(h.num_rows, -1) for h in held])
                    labels = np.array([codes.setdefault(v, len(codes)) for h in held for v in h.column("label").to_pylist()])
                    own, other, total, seen = np.full(len(x), np.nan), np.full(len(x), np.nan), np.zeros(len(x)), np.zeros(len(x), bool)
                for v, m, data in zip(*(part.column(c).to_pylist() for c in ("label", "n", "data")), strict=True):
                    now = codes.setdefault(v, len(codes))
                    if now != code:
                        closed()
                        code, count = now, 0
                        total[:] = 0
                    total += _distance_sums(x, np.frombuffer(data, np.float64 if len(data) == 8 * m * x.shape[1] else np.float32).reshape(m, -1).astype(np.float64))
                    count += m
                    sizes[now] = count
        if held:
            closed()
            yield rows_of()

    s = met.mapInArrow(means, f"key {key_type}, label {label_type}, own double, other double")
    if n < 2:
        s = s.limit(0)
    else:
        s = s.unionByName(rows.where(~whole).select("key", "label", F.lit(None).cast("double").alias("own"), F.lit(None).cast("double").alias("other")))
    most_of = F.greatest("own", "other")
    # 0 / 0, where all points of both labels are one, is NaN, as in SQL.
    value = F.when(F.col("own").isNotNull() & F.col("other").isNotNull(), F.when(most_of == 0, F.lit(float("nan"))).otherwise((F.col("other") - F.col("own")) / F.nullif(most_of, F.lit(0.0))))
    return s.select(F.col("key").alias(key), F.col("label").alias(label), F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def sampled_silhouettes(points: DataFrame, key: str, features: list[str], label: str, by: str, groups: int, most: int = 1000) -> DataFrame:
    """by, silhouette: the mean of silhouette() for each of the `groups` groups of by, over the `most` points by hash of the key. Each group has every key."""
    sample = points.select(by, key, label, *features).orderBy(F.xxhash64(key), key).limit(most * groups)  # the same keys in each group

    def mean(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy() for c in features])
        code = table.column(label).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = np.bincount(code)
        d = np.column_stack([_distance_sums(x, x[code == c]) for c in range(len(n))])
        own = d[np.arange(len(x)), code] / np.maximum(1, n[code] - 1)
        d = d / n
        d[np.arange(len(x)), code] = np.inf
        other = d.min(axis=1)
        good = (n[code] > 1) & (len(n) > 1)
        with np.errstate(invalid="ignore"):
            s = np.where(good, (other - own) / np.maximum(own, other), 0.0)
        return pa.table({by: table.column(by)[:1], "silhouette": [float(s.mean())]})

    return sample.groupBy(by).applyInArrow(mean, f"{by} {dict(points.dtypes)[by]}, silhouette double")


def choose_k(sweep: DataFrame) -> DataFrame:
    """One row: k_chosen, k_elbow for sweep (k, inertia, silhouette, ch).

    Only k >= 3 can be chosen, and only those are neighbours: of those with a silhouette above both neighbours', the one with the best ch;
    without any, the one with the best silhouette; the least k of equals. Elbow: where the negated second difference of the inertia is largest,
    over all k. Null where no k is left. A sweep has a row for each k that was tried, so it is one small group.
    """
    w = Window.partitionBy(F.col("k") >= 3).orderBy("k")
    d = sweep.withColumns({"p": F.lag("silhouette").over(w), "n": F.lead("silhouette").over(w)}).withColumns({"peak": (F.col("k") >= 3) & (F.col("silhouette") > F.col("p")) & (F.col("silhouette") > F.col("n"))})
    all_ = Window.partitionBy(F.lit(0)).orderBy("k")
    d = d.withColumn("bend", -(F.lead("inertia").over(all_) - 2 * F.col("inertia") + F.lag("inertia").over(all_)))
    best = lambda when, by: F.max_by(F.when(when, F.col("k")), F.when(when, F.struct(F.col(by), -F.col("k"))))
    return d.agg(F.coalesce(best(F.col("peak"), "ch"), best(F.col("k") >= 3, "silhouette")).alias("k_chosen"), F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", -F.col("k")))).alias("k_elbow"))


def profiles(df: DataFrame, label: str, means: list[str], modes: list[str], rank_by: str, names: list[str]) -> DataFrame:
    """label, n, means, modes (least of equals), name: the i-th name to the group with the i-th lowest mean of rank_by."""
    g = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means], *[F.mode(F.col(c), True).alias(c) for c in modes])
    return g.withColumn("name", F.get(F.array(*map(F.lit, names)), F.row_number().over(Window.orderBy(rank_by, label)) - 1))


def min_max(df: DataFrame, columns: list[str], eps: float = 1e-9) -> DataFrame:
    w = Window.partitionBy()
    return df.withColumns({c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + eps) for c in columns})


def pca(vectors: DataFrame, key: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(key, c1 .. ck) and the explained shares; vectors are taken as centred (z-scores are). Signs are arbitrary."""
    m = PCA(k=k, inputCol="v", outputCol="c").fit(vectors)
    c = vector_to_array("c")
    return m.transform(vectors).select(key, *[c[i].alias(f"c{i + 1}") for i in range(k)]), [float(x) for x in m.explainedVariance]


def _linked(x: np.ndarray, weight: np.ndarray, ks: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Labels of weighted points at each k of a Ward dendrogram."""
    n = len(x)
    size, live, group = weight.astype(float), np.ones(n, bool), np.arange(n)
    d = ((x[:, None] - x[None]) ** 2).sum(2) * 2 * size[:, None] * size[None] / (size[:, None] + size[None])
    np.fill_diagonal(d, np.inf)
    out = {}
    for left in range(n, 0, -1):
        if left in ks:
            out[left] = np.unique(group, return_inverse=True)[1]
        if left == 1:
            break
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        new[~live] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        live[j] = False
        group[group == j] = i
    return out


def ward(points: DataFrame, key: str, features: list[str], ks: tuple[int, ...] = tuple(range(2, 9)), groups: int = 400, seed: int = 0) -> DataFrame:
    """key, k, cluster of every point: Ward linkage cut at each k.

    A dendrogram is one value, so it is built over at most `groups` groups of points, each with its centre and weight: with so few points
    each is its own, so the result is exact; else they are K-Means cells, and a point gets its cell's cluster.
    """
    if points.count() <= groups:
        cells = points.select(key, *features, F.row_number().over(Window.orderBy(key)).alias("_g"))
    else:
        cells = kmeans(assembled(points, key, features), key, groups, 1, seed, 20)[0].withColumnRenamed("cluster", "_g").join(points, key).select(key, *features, "_g")
    centres = cells.groupBy("_g").agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in features]).orderBy("_g").toPandas()
    cut = _linked(centres[features].to_numpy(float), centres["_n"].to_numpy(), ks)
    rows = [(int(g), int(k), int(c)) for k, labels in sorted(cut.items()) for g, c in zip(centres["_g"], labels, strict=True)]
    named = points.sparkSession.createDataFrame(rows, "_g int, k int, cluster int")
    return cells.select(key, F.col("_g").cast("int").alias("_g")).join(F.broadcast(named), "_g").select(key, "k", "cluster")  # groups x ks rows


def pairwise_agreement(runs: DataFrame, key: str, run: str, label: str) -> DataFrame:
    """run_a < run_b, ari of labellings in one long table: contingency counts of all pairs of runs in one join by key."""
    a, b = (runs.select(key, F.col(run).alias(f"run_{s}"), F.col(label).alias(s)) for s in "uv")
    cells = a.join(b, key).filter("run_u < run_v").groupBy("run_u", "run_v", "u", "v").agg(F.count("*").alias("c"))
    pick = lambda c: c * (c - 1) / 2
    w = lambda *by: Window.partitionBy("run_u", "run_v", *by)
    d = cells.withColumns({"a": F.sum("c").over(w("u")), "b": F.sum("c").over(w("v")), "n": F.sum("c").over(w())})
    g = d.groupBy("run_u", "run_v").agg(F.first("n").alias("n"), F.sum(pick(F.col("c"))).alias("same"), F.sum(pick(F.col("a")) * F.col("c") / F.col("a")).alias("su"), F.sum(pick(F.col("b")) * F.col("c") / F.col("b")).alias("sv"))
    e = F.col("su") * F.col("sv") / pick(F.col("n"))
    top = (F.col("su") + F.col("sv")) / 2 - e
    return g.select(F.col("run_u").alias("run_a"), F.col("run_v").alias("run_b"), F.when(top == 0, 1.0).otherwise((F.col("same") - e) / top).alias("ari"))


__all__ = ["agreement", "assembled", "choose_k", "kmeans", "min_max", "pairwise_agreement", "pca", "profiles", "quality", "sampled_silhouettes", "silhouette", "ward"]
