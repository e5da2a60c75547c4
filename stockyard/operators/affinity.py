"""Which items go together: supports, pair counts, lift, and its exact significance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions import tails


def pair_counts(sessions: DataFrame) -> DataFrame:
    """a < b, together: pairs within each basket's own array (5 to 15 items, so 105 pairs at most), summed before the shuffle; no self-join."""
    pairs = F.flatten(F.transform("skus", lambda a, i: F.transform(F.slice("skus", i + 2, F.size("skus")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sessions.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together"))


def supports(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.explode("skus").alias("sku")).groupBy("sku").agg(F.count("*").alias("n"))


def pairs_with_lift(sessions: DataFrame, share: float = 0.001, least: int = 2) -> DataFrame:
    """a, b, together, n_a, n_b, n, support, confidence, lift of pairs with max(least, floor(share x sessions)) common sessions."""
    total = sessions.agg(F.count("*").alias("n"))
    one = supports(sessions)
    p = pair_counts(sessions).join(F.broadcast(total)).filter(F.col("together") >= F.greatest(F.lit(least), F.floor(share * F.col("n"))))
    p = p.join(one.select(F.col("sku").alias("a"), F.col("n").alias("n_a")), "a").join(one.select(F.col("sku").alias("b"), F.col("n").alias("n_b")), "b")
    return p.select("a", "b", "together", "n_a", "n_b", "n", (F.col("together") / F.col("n")).alias("support"), (F.col("together") / F.col("n_a")).alias("confidence"), (F.col("together") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def top_pairs(pairs: DataFrame, n: int = 200) -> DataFrame:
    return pairs.orderBy(F.desc("lift"), F.desc("together"), "a", "b").limit(n)


def validated(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p: the exact law of what shuffling one item over the sessions gives; validated where p < alpha."""

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tails.hypergeometric_upper(*map(int, x)) for x in zip(k, n, a, b, strict=True)])

    return pairs.withColumn("p", p_value("together", "n", "n_a", "n_b")).withColumn("validated", F.coalesce(F.col("p") < alpha, F.lit(False)))
