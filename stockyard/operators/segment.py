"""SKU segmentation: features from sparse facts, z-scores, ABC and XYZ classes, agreement and separation of groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators import panel as P
from stockyard.operators.running import running

FEATURES = ("mean_demand", "std_demand", "cv", "total_revenue", "revenue_rank", "frequency", "mean_nonzero", "trend", "seasonality")


def sku_features(facts: DataFrame) -> DataFrame:
    """The nine features of each sku over the zero-filled span of all days, without filling it.

    Zero days add nothing to the sums that mean, variance, slope and monthly means are made of; only their number matters, and that is
    the calendar's. So this is two aggregates over facts and no panel of sku x day.
    """
    span = facts.agg(F.min("date").alias("d0"), F.max("date").alias("d1")).select("d0", "d1", (F.datediff("d1", "d0") + 1).alias("days"))
    months = span.select(F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("d")).groupBy(F.month("d").alias("month")).agg(F.count("*").alias("month_days"))
    daily = facts.groupBy("sku", "date").agg(F.sum("qty").alias("q"), F.sum("revenue").alias("revenue"))
    daily = daily.join(F.broadcast(span)).withColumn("t", F.datediff("date", "d0"))
    monthly = daily.groupBy("sku", F.month("date").alias("month")).agg(F.first("days").alias("days"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"), F.sum(F.col("q") * F.col("t")).alias("ts"), F.count_if(F.col("q") > 0).alias("nz"), F.sum("revenue").alias("revenue"))
    g = monthly.join(F.broadcast(months), "month").groupBy("sku").agg(F.first("days").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("ts").alias("ts"), F.sum("nz").alias("nz"), F.sum("revenue").alias("rev"), F.sum(F.col("s") * F.col("s") / F.col("month_days")).alias("sm"))
    n, s = F.col("n").cast("double"), F.col("s")
    mean, ss = s / n, F.col("ss") - s * s / n
    std = F.sqrt(ss / (n - 1))
    st, stt = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    trend = F.when(n >= 10, (F.col("ts") - st * mean) / (stt - st * st / n)).otherwise(0.0)
    seasonal = F.when((n >= 24) & (ss > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("sm") - s * s / n) / ss))).otherwise(0.0)
    out = g.select("sku", mean.alias("mean_demand"), std.alias("std_demand"), F.when(mean > 0, std / mean).otherwise(0.0).alias("cv"), F.col("rev").cast("double").alias("total_revenue"), (F.col("nz") / n).alias("frequency"), F.when(F.col("nz") > 0, s / F.col("nz")).otherwise(0.0).alias("mean_nonzero"), trend.alias("trend"), seasonal.alias("seasonality"))
    return out.withColumn("revenue_rank", P.percentile_rank("total_revenue"))


def z_scores(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """{c}_z with the population deviation; 0 where that is 0. The one-row statistics are broadcast, so no global window."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = {f"{c}_z": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def abc(df: DataFrame, value: str = "total_revenue", key: str = "sku", a: float = 0.70, b: float = 0.90) -> DataFrame:
    """abc by cumulative share, largest first; who crosses a line falls to the next class. Summed in pieces with carried totals, so there may be any number of keys."""
    total = df.agg(F.sum(value).alias("_all"))  # one row
    summed = running(df, [F.col(value).desc(), F.col(key)], sums={"_upto": value}).join(F.broadcast(total))
    return summed.withColumn("cum_share", F.col("_upto") / F.col("_all")).drop("_upto", "_all").withColumn("abc", F.when(F.col("cum_share") <= a, "A").when(F.col("cum_share") <= b, "B").otherwise("C"))


def xyz(cv: Column, x: float = 0.5, y: float = 1.0) -> Column:
    return F.when(cv < x, "X").when(cv < y, "Y").otherwise("Z")


def classified(features: DataFrame) -> DataFrame:
    return abc(features).withColumn("xyz", xyz(F.col("cv"))).withColumn("abc_xyz", F.concat("abc", "xyz"))


def agreement(df: DataFrame, u: str, v: str) -> DataFrame:
    """One row: n, ari, nmi (arithmetic normaliser, natural logarithm) of two labellings, from their contingency counts."""
    cells = df.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count("*").alias("c"))
    cells = cells.withColumns({"a": F.sum("c").over(Window.partitionBy("u")), "b": F.sum("c").over(Window.partitionBy("v")), "n": F.sum("c").over(Window.partitionBy())})
    pick = lambda c: c * (c - 1) / 2
    g = cells.agg(
        F.first("n").alias("n"),
        F.sum(pick(F.col("c"))).alias("same"),
        F.sum(pick(F.col("a")) * F.col("c") / F.col("a")).alias("su"),
        F.sum(pick(F.col("b")) * F.col("c") / F.col("b")).alias("sv"),
        F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(F.col("c") / F.col("n") * F.log(F.col("a") / F.col("n")))).alias("hu"),
        (-F.sum(F.col("c") / F.col("n") * F.log(F.col("b") / F.col("n")))).alias("hv"),
    )
    expected = F.col("su") * F.col("sv") / pick(F.col("n"))
    top = (F.col("su") + F.col("sv")) / 2 - expected
    return g.select("n", F.when(top == 0, 1.0).otherwise((F.col("same") - expected) / top).alias("ari"), F.when(F.col("hu") + F.col("hv") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("hu") + F.col("hv"))).alias("nmi"))


def separation(df: DataFrame, groupings: list[str], rate: str, value: str) -> DataFrame:
    """grouping, n_groups, rate_range, value_ratio (largest to smallest mean), mean_cv (of value within groups)."""
    long = df.select(rate, value, F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("label")) for g in groupings])).alias("g")).select(rate, value, "g.*")
    per = long.groupBy("grouping", "label").agg(F.avg(rate).alias("r"), F.avg(value).alias("v"), F.when(F.avg(value) > 0, F.stddev_samp(value) / F.avg(value)).otherwise(0.0).alias("cv"))
    return per.groupBy("grouping").agg(F.count("*").alias("n_groups"), (F.max("r") - F.min("r")).alias("rate_range"), (F.max("v") / F.min("v")).alias("value_ratio"), F.avg("cv").alias("mean_cv"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str], share: bool = False) -> DataFrame:
    """Counts of row x column, the listed values as columns; as shares of the row if asked."""
    t = df.groupBy(row).pivot(column, values).count().fillna(0, values)
    if not share:
        return t
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return t.select(row, *[(F.col(v) / total).alias(v) for v in values])


def modal(column: str) -> Column:
    """The commonest value, the least among equals."""
    return F.mode(F.col(column), True)
