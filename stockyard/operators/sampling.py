"""Samples that depend on keys and a seed only, not on partitions or runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.running import running


def counter(key: str, seed: int) -> Column:
    """A whole number below 2**60 for a key: the first 15 hex digits of md5("key:seed"), so any SQL engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def draw(key: str, seed: int) -> Column:
    return counter(key, seed)


def simple(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows; a top-n, so nothing is sorted whole."""
    return df.orderBy(draw(key, seed), key).limit(n)


def share(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.filter(draw(key, seed) % 1_000_000 < int(fraction * 1_000_000))


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows in proportion to strata; quotas round half to even."""
    total = df.agg(F.count("*").alias("_all"))
    w = Window.partitionBy(stratum)
    d = df.join(F.broadcast(total)).withColumn("_q", F.bround(F.lit(n) * F.count("*").over(w) / F.col("_all"))).withColumn("_r", F.row_number().over(w.orderBy(draw(key, seed), key)))
    return d.filter(F.col("_r") <= F.col("_q")).drop("_all", "_q", "_r")


def bootstrap(df: DataFrame, order: str, seed: int = 42) -> DataFrame:
    """As many rows again, drawn with replacement: draw i takes row md5(i:seed) mod n, by an equi-join on positions. SQL can repeat the draws."""
    n = df.agg(F.count("*").alias("_n"))
    rows = running(df, [F.col(order)], number="_i").withColumn("_i", F.col("_i") - 1)
    picks = rows.select("_i").join(F.broadcast(n)).select((counter("_i", seed) % F.col("_n")).alias("_i"))
    return picks.join(rows, "_i").drop("_i")


def one_per_category(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first row of each category, in order, at most n; then the next best rows fill what is left."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    d = df.withColumn("_second", (first > 1).cast("int"))
    return d.orderBy("_second", *order).limit(n).drop("_second")
