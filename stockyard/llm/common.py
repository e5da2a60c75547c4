"""What the operators of this subpackage share: tables, and folders that all executors see."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond it the same join shuffles. 200,000 rows of a few numbers are under 10 MB.
BROADCAST_ROWS = 200_000


def col(name: str) -> Column:
    """A column by its whole name, whatever dots or spaces that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="stockyard-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path as its object: for metadata only."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Cut lineage by a table in the shared folder; also gives its path, for drop_path() once nothing reads it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = df.schema
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer whole texts than Spark's 10,000 rows, for this session; a setting that isn't the default stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(rows))


def small_or_not(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if a count proves it small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages now: it does so when their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()
