"""Recency, frequency, monetary value; quintile scores, segments and their checks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators import panel as P

#: Segment rules, first match wins: name, least and most r, f, m (fixed values).
SEGMENTS = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal", (3, 5), (4, 5), (1, 5)),
    ("Potential Loyalist", (4, 5), (1, 3), (3, 5)),
    ("At Risk", (1, 2), (3, 5), (1, 5)),
    ("Lost Cheap", (1, 1), (1, 2), (1, 2)),
    ("Lost", (1, 2), (1, 2), (1, 5)),
    ("Needs Attention", (3, 3), (3, 3), (3, 3)),
    ("New Customers", (4, 5), (1, 2), (1, 2)),
    ("Promising", (3, 5), (1, 2), (1, 3)),
)


def rfm(sales: DataFrame, reference: datetime.date) -> DataFrame:
    """customer, recency (days to the reference date), frequency, monetary: one partial aggregate before the shuffle."""
    g = sales.groupBy("customer").agg(F.max("date").alias("last"), F.count("*").alias("frequency"), F.sum("revenue").alias("monetary"))
    return g.select("customer", F.datediff(F.lit(reference), "last").alias("recency"), "frequency", "monetary")


def scores(table: DataFrame) -> DataFrame:
    """Quintiles 1 to 5 by first-rank (ties by customer), recency turned round; sum and three-digit code. Windows over customers, not facts."""
    return table.withColumns({"r": 6 - P.first_rank_quintile(F.col("recency"), "customer"), "f": P.first_rank_quintile(F.col("frequency"), "customer"), "m": P.first_rank_quintile(F.col("monetary"), "customer")}).withColumns(
        {"rfm_sum": F.col("r") + F.col("f") + F.col("m"), "rfm_code": F.concat(*[F.col(c).cast("string") for c in "rfm"])}
    )


def segment(rules=SEGMENTS, other: str = "Others") -> Column:
    out = None
    for name, *bounds in rules:
        fits = F.lit(True)
        for c, (lo, hi) in zip("rfm", bounds, strict=True):
            fits &= F.col(c).between(lo, hi)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(other)


def segments(sales: DataFrame, reference: datetime.date) -> DataFrame:
    return scores(rfm(sales, reference)).withColumn("segment", segment())


def spearman(df: DataFrame, pairs: list[tuple[str, str]], flag: float = 0.3) -> DataFrame:
    """a, b, n, rho, flagged: average ranks, then Pearson."""
    names = sorted({c for p in pairs for c in p})
    ranks = df.select(*[P.average_rank(c, []).alias(c) for c in names])
    got = ranks.agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    return got.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.col(f"{a}_{b}").alias("rho")) for a, b in pairs])).alias("x")).select("x.*", (F.abs("x.rho") > flag).alias("flagged"))


def population(df: DataFrame, by: str = "segment") -> DataFrame:
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return g.withColumn("pct", 100 * F.col("n") / F.sum("n").over(P.Window.partitionBy()))


def boundary_stability(df: DataFrame, column: str, rounds: int = 50, share: float = 0.7, most: float = 0.10) -> DataFrame:
    """Do the raw-value quintile edges move between seeded subsamples? edge, mean, cv, stable. A row is in round i by a hash of key and i."""
    each = df.select("customer", F.col(column).cast("double").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    each = each.filter(F.pmod(F.xxhash64("customer", "round"), F.lit(1000)) < int(share * 1000))
    edges = each.groupBy("round").agg(F.percentile("x", F.array(*[F.lit(q / 5) for q in range(1, 5)])).alias("e")).select("round", F.posexplode("e").alias("edge", "v"))
    return edges.groupBy("edge").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.avg("v")).alias("cv")).withColumn("stable", F.col("cv") < most)
