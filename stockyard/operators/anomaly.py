"""Local Outlier Factor, and what compares detectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.running import running
from stockyard.operators.segment import z_scores
from stockyard.sources.files import scratch


def z_by_group(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Population z-scores within groups, in place of the features."""
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0) for c in features})


def _packed(by: list[str], features: list[str], k: int):
    """applyInArrow: a block's rows as one row: by, _at, _lo and _hi (its box), _most (no row's k-th neighbour is further), _data (numbers, features)."""

    def pack(t: pa.Table) -> pa.Table:
        number = t.column("_rid").to_numpy()
        x = np.column_stack([t.column(c).to_numpy() for c in features]).astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            d = _gaps(x, x)
        np.fill_diagonal(d, np.inf)
        most = float(np.partition(d, k - 1, axis=1)[:, k - 1].max()) if len(x) > k else np.inf
        lo, hi = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
        return pa.table({**{c: t.column(c)[:1] for c in [*by, "_at"]}, "_lo": [lo.tolist()], "_hi": [hi.tolist()], "_most": [most], "_data": [number.astype(np.int64).tobytes() + x.tobytes()]})

    return pack


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by plain arithmetic, feature after feature; infinite where one is missing."""
    d = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        gap = a[:, f, None] - b[:, f]
        d += np.multiply(gap, gap, out=gap)
    np.sqrt(d, out=d)
    d[np.isnan(d)] = np.inf
    return d


def _unpacked(data: bytes, features: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 * (1 + features))
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, offset=8 * n).reshape(n, features)


def _least(d: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k least of (d, number), in that order."""
    cut = np.partition(d, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(d <= cut[:, None])
    value, of = d[row, col], np.broadcast_to(number, d.shape)[row, col]
    order = np.lexsort((of, value, row))
    first = np.searchsorted(row, np.arange(len(d)))
    at = (first[:, None] + np.arange(k)).ravel()
    return value[order][at].reshape(-1, k), of[order][at].reshape(-1, k)


def neighbours(df: DataFrame, key: list[str], features: list[str], by: list[str], k: int = 20, block: int = 1024, tile: int = 128) -> tuple[DataFrame, DataFrame]:
    """The rows with their number _rid along key in their group, and (by, a, kd, near): of each row (a number) the k nearest others of its group
    as structs (b, d), by distance and then key, and the k-th distance. Groups of k rows or fewer are left out; a missing feature is far from all.

    Rows are sorted by features and cut into blocks. A block's own rows bound how far its neighbours are, and only blocks whose boxes come
    that near meet it, the nearest first; so the search is exact, and blocks far apart are never paired.
    """
    spark, many = df.sparkSession, len(features)
    n = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > k)
    rows = df.join(n, by).select(*by, *[c for c in key if c not in by], *[F.col(c).cast("double").alias(c) for c in features])
    rows = running(rows, [F.col(c) for c in key if c not in by], by, number="_rid")
    path = scratch(spark, "numbered")
    running(rows, [F.col(c) for c in [*features, "_rid"]], by, number="_pos").withColumn("_at", F.floor((F.col("_pos") - 1) / block)).drop("_pos").write.parquet(path)
    rows = spark.read.parquet(path)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    schema = f"{kinds}, _at bigint, _lo array<double>, _hi array<double>, _most double, _data binary"
    path = scratch(spark, "blocks")
    rows.select(*by, "_at", "_rid", *features).groupBy(*by, "_at").applyInArrow(_packed(by, features, k), schema).write.parquet(path)
    blocks = spark.read.parquet(path)
    ends = blocks.select(*by, F.col("_at").alias("_a"), F.col("_lo").alias("_alo"), F.col("_hi").alias("_ahi"), "_most")
    apart = lambda f: F.greatest(F.lit(0.0), F.col("_alo")[f] - F.col("_hi")[f], F.col("_lo")[f] - F.col("_ahi")[f])
    gap = F.sqrt(sum((F.when(F.isnan(apart(f)), 0.0).otherwise(apart(f)) ** 2 for f in range(many)), F.lit(0.0)))
    pairs = ends.join(blocks.select(*by, F.col("_at").alias("_b"), "_lo", "_hi"), by).withColumn("_gap", gap).where(F.col("_gap") <= F.col("_most") * (1 + 1e-9))
    met = pairs.select(*by, "_a", F.col("_b").alias("_at"), "_gap").join(blocks.select(*by, "_at", "_data"), [*by, "_at"]).select(*by, "_a", "_gap", "_data")
    own = blocks.select(*by, F.col("_at").alias("_a"), F.lit(-1.0).alias("_gap"), "_data")  # what meets the others
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.unionByName(met).repartition(tasks, *by, "_a").sortWithinPartitions(*by, "_a", "_gap")

    def search(batches):
        now = number = None

        def found():
            flat = pa.StructArray.from_arrays([pa.array(best_b.ravel()), pa.array(best.ravel(), mask=np.isinf(best.ravel()))], ["b", "d"])
            near = pa.ListArray.from_arrays(np.arange(0, k * len(number) + 1, k, np.int32), flat)
            last = best[:, k - 1]
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(number), t) for v, t in zip(now, types, strict=True)), pa.array(number), pa.array(last, mask=np.isinf(last)), near], [*by, "a", "kd", "near"])

        for batch in batches:
            types = [batch.column(c).type for c in by]
            for i in range(batch.num_rows):
                data = batch.column("_data")[i].as_py()
                if batch.column("_gap")[i].as_py() < 0:
                    if number is not None:
                        yield found()
                    now = [batch.column(c)[i].as_py() for c in by]
                    number, x = _unpacked(data, many)
                    best, best_b = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
                    tiles = [slice(j, j + tile) for j in range(0, len(x), tile)]
                    boxes = [(np.fmin.reduce(x[s]), np.fmax.reduce(x[s])) for s in tiles]
                    continue
                other, y = _unpacked(data, many)
                lo, hi = np.fmin.reduce(y), np.fmax.reduce(y)
                for s, (tlo, thi) in zip(tiles, boxes, strict=True):
                    away = np.sqrt(np.nansum(np.fmax(0.0, np.fmax(tlo - hi, lo - thi)) ** 2))
                    if away > best[s, k - 1].max() * (1 + 1e-9):
                        continue
                    with np.errstate(invalid="ignore", over="ignore"):
                        d = _gaps(x[s], y)
                    # A row isn't its own neighbour: behind all others, those that are infinitely far too.
                    me = number[s, None] == other
                    d[me] = np.inf
                    of = np.where(me, np.iinfo(np.int64).max, other)
                    best[s], best_b[s] = _least(np.hstack([best[s], d]), np.hstack([best_b[s], of]), k)
        if number is not None:
            yield found()

    path = scratch(spark, "neighbours")
    near = stream.mapInArrow(search, f"{kinds}, a bigint, kd double, near array<struct<b: bigint, d: double>>")
    near.write.parquet(path)
    return rows, spark.read.schema(near.schema).parquet(path)


def lof(df: DataFrame, key: list[str], features: list[str], by: list[str], k: int = 20, block: int = 1024) -> DataFrame:
    """key, by, lof: exact k nearest neighbours within each group of `by` (needs more than k rows, else the group is left out)."""
    rows, near = neighbours(df, key, features, by, k, block)
    pairs = near.select(*by, "a", F.explode("near").alias("_p")).select(*by, "a", "_p.b", "_p.d")
    reach = pairs.join(near.select(*by, F.col("a").alias("b"), "kd"), [*by, "b"]).select(*by, "a", "b", F.greatest("d", "kd").alias("reach"))
    lrd = reach.groupBy(*by, "a").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = lrd.select(*by, F.col("a").alias("b"), F.col("lrd").alias("lrd_b"))
    out = pairs.join(other, [*by, "b"]).groupBy(*by, "a").agg(F.avg("lrd_b").alias("m")).join(lrd, [*by, "a"])
    named = rows.select(*by, F.col("_rid").alias("a"), *[c for c in key if c not in by])
    return out.join(named, [*by, "a"]).select(*key, *[c for c in by if c not in key], (F.col("m") / F.col("lrd")).alias("lof"))


def flag_share(df: DataFrame, score: str, contamination: float, by: list[str] | None = None) -> DataFrame:
    """flag: the `contamination` share with the highest score, by an exact quantile joined back (one row, or one a group)."""
    cut = df.groupBy(*(by or [])).agg(F.percentile(score, F.lit(1 - contamination)).alias("_cut"))
    return (df.join(cut, by) if by else df.join(F.broadcast(cut))).withColumn("flag", F.col(score) > F.col("_cut")).drop("_cut")


# Comparison


def overlap(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, both, only_a, only_b, jaccard, kappa of boolean columns."""
    n = F.count("*")
    aggs = []
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), n.alias("n")).alias(f"{a}_{b}"))
    o = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"{a}_{b}") for a, b in pairs])).alias("o")).select("o.*")
    either = F.col("both") + F.col("only_a") + F.col("only_b")
    po = (F.col("n") - F.col("only_a") - F.col("only_b")) / F.col("n")
    pa, pb = (F.col("both") + F.col("only_a")) / F.col("n"), (F.col("both") + F.col("only_b")) / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    return o.select("a", "b", "both", "only_a", "only_b", F.when(either > 0, F.col("both") / either).otherwise(0.0).alias("jaccard"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def agreement_label(flags: list[Column]) -> Column:
    n = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return F.when(n == len(flags), "all").when(n >= 2, "partial").when(n == 1, "single").otherwise("none")


__all__ = ["agreement_label", "flag_share", "lof", "neighbours", "overlap", "z_by_group", "z_scores"]
