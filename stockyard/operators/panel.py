"""Dense panels and what reads them: spines, lags, trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.running import running


def spine(df: DataFrame, date: str = "date") -> DataFrame:
    """Every day from the first to the last of df."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))


def densify(df: DataFrame, key: str = "k", date: str = "date", value: str = "q") -> DataFrame:
    """Key x day, zero where df has no row: each key carries the spine as an array, so the product is an explode and no cross join."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    keys = df.select(key).distinct().join(F.broadcast(span))  # one row
    grid = keys.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))
    return grid.join(df, [key, date], "left").select(key, date, F.coalesce(value, F.lit(0.0)).alias(value))


def lags(value: str, by: str, order: str, steps: tuple[int, ...]) -> dict[str, Column]:
    w = Window.partitionBy(by).orderBy(order)
    return {f"lag_{n}": F.lag(value, n).over(w) for n in steps}


def trailing_means(value: str, by: str, order: str, sizes: tuple[int, ...]) -> dict[str, Column]:
    """Means of the last n rows before the current one; one row is enough."""
    w = Window.partitionBy(by).orderBy(order)
    return {f"mean_{n}": F.avg(value).over(w.rowsBetween(-n, -1)) for n in sizes}


def trailing_std(value: str, by: str, order: str, size: int = 7) -> Column:
    """Sample deviation of the last rows before the current one; 0 for fewer than two."""
    return F.coalesce(F.stddev_samp(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(-size, -1)), F.lit(0.0))


def days_since(flag: Column, by: str, order: str, never: int = 999) -> Column:
    """Rows since the last one with the flag, this one included; `never` before the first."""
    w = Window.partitionBy(by).orderBy(order)
    i = F.row_number().over(w)
    return F.lit(i).cast("bigint") if flag is None else F.coalesce(F.col("_i") - F.max(F.when(flag, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(never))


def ranked(order: list[Column], by: list[str] | None = None) -> Column:
    return F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order))


def label_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): 0 .. n - 1 by sorted distinct value, null first. Numbered in pieces, so there may be any number of values."""
    codes = running(df.select(column).distinct(), [F.col(column)], number=name)
    return codes.withColumn(name, (F.col(name) - 1).cast("int"))


def first_rank_quintile(value: Column, tie: str, bins: int = 5) -> Column:
    """Equal-width bins of the first-rank: (bins * row_number + n - 1) div n. Sizes differ from ntile's."""
    rn, n = F.row_number().over(Window.orderBy(value, tie)), F.count("*").over(Window.partitionBy())
    return F.floor((bins * rn + n - 1) / n).cast("int")


def percentile_rank(value: str) -> Column:
    """Rank with average ties over the number of rows."""
    return (F.rank().over(Window.orderBy(value)) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2) / F.count("*").over(Window.partitionBy())


def average_rank(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2
