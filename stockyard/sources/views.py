"""The domain tables, as views over the tables of a folder (orders, lineitem, part, events ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.sources.files import read_table


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, date, warehouse, qty, revenue, stockout, category, brand: a row per order line."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return facts(spark, sf_dir).join(part, "sku")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """demand() without the attributes of part, so without a join."""
    line = read_table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_partkey").alias("sku"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_suppkey") % 3).alias("warehouse"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"),
        (F.col("l_returnflag") == "R").cast("int").alias("stockout"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("task"),
        F.col("user_id").alias("operator"),
        (F.col("user_id") % 3).alias("warehouse"),
        F.col("ts").cast("date").alias("date"),
        F.when(F.col("event_id") % 2 == 0, "Pick").otherwise("Putaway").alias("task_type"),
        (F.col("event_type") == "error").cast("int").alias("error"),
        F.col("value").cast("decimal(18,4)").alias("duration"),
    )


def series(spark: SparkSession, sf_dir: str, key: str = "category") -> DataFrame:
    """k, date, q: a series a category or brand. Lines are summed by sku and date before the join with part."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_type" if key == "category" else "p_brand").alias("k"))
    daily = facts(spark, sf_dir).groupBy("sku", "date").agg(F.sum("qty").alias("q"))
    return daily.join(part, "sku").groupBy("k", "date").agg(F.sum("q").alias("q"))


def dense(spark: SparkSession, sf_dir: str, key: str = "category") -> DataFrame:
    """series() with every day from the first to the last, zero where nothing was sold."""
    from stockyard.operators.panel import densify

    return densify(series(spark, sf_dir, key))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, skus (sorted distinct array) of baskets with 5 to 15 distinct parts."""
    from stockyard.operators.routing import pick_sessions

    line = read_table(spark, sf_dir, "lineitem")
    return pick_sessions(line.select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("sku")))
