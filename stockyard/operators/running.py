"""Row numbers and running sums in an order over a whole table, or over groups of any size, that no single task has to sort.

Rows are cut into pieces along the order. Each piece numbers and sums its own rows; the totals of the pieces before it are carried over.
A group that lies in one piece carries nothing, and each cut parts one group at most, so there are fewer rows to carry than pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.sources.files import scratch


def pieces(df: DataFrame, order: list[Column], by: list[str], name: str = "pieces") -> DataFrame:
    """df with _piece, rising along (by, order), as a written table: where range partitions end depends on a sample, so they must be drawn once only."""
    spark = df.sparkSession
    path = scratch(spark, name)
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).withColumn("_piece", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def running(df: DataFrame, order: list[Column], by: list[str] | None = None, sums: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """df with its row number (from 1, as `number`) and running sums {new column: column}, this row included, along `order` in each group of `by`.

    Nulls of `by` are a group; nulls in sums add nothing. Rows equal in `order` come in any order among themselves. No row gives no row.
    """
    by, sums = by or [], sums or {}
    cut = pieces(df, order, by)
    own = Window.partitionBy(*by, "_piece")
    so_far = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_of_{k}") for k, c in enumerate(sums.values())))
    # Over totals: a row for each group and piece; without groups a row for each piece.
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(b).alias(f"_by_{k}") for k, b in enumerate(by)], F.col("_piece").alias("_at"), *(F.sum(c).over(before).alias(f"_c{c}") for c in ["_rows", *(f"_of_{k}" for k in range(len(sums)))])).where("_c_rows IS NOT NULL")
    same = F.col("_piece") == F.col("_at")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{k}"))
    local = cut.withColumns(({number: F.row_number().over(own.orderBy(*order)).cast("bigint")} if number else {}) | {n: F.sum(c).over(so_far) for n, c in sums.items()})
    out = local.join(F.broadcast(carried), same, "left")  # fewer rows than partitions
    plus = {n: F.when(F.col(f"_c_of_{k}").isNull(), F.col(n)).otherwise(F.coalesce(F.col(n), F.lit(0)) + F.col(f"_c_of_{k}")) for k, n in enumerate(sums)}
    if number:
        plus[number] = F.col(number) + F.coalesce("_c_rows", F.lit(0))
    return out.select(*[F.col(c) for c in df.columns if c not in plus], *[v.alias(n) for n, v in plus.items()])
