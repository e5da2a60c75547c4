"""CSV and Parquet edges: explicit schemas, never inferred; lists travel through CSV as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the six source tables.
SCHEMAS = {
    "daily_demand": "Date date, SKU_ID string, Warehouse_ID string, ABC_Class string, XYZ_Class string, Category string, Quantity_Demanded bigint, Quantity_Fulfilled bigint, Revenue double, Stockout_Flag int",
    "outbound_orders": "Order_ID string, Customer_ID string, Order_Date date, Revenue double",
    "customers": "Customer_ID string, Customer_Type string, Region string",
    "wms_tasks": "Task_ID string, Warehouse_ID string, Operator_ID string, SKU_ID string, Shift string, Task_Type string, Task_Date date, Accuracy_Flag int, Error_Code string, Duration_Min double",
    "warehouse_locations": "Location_ID string, Warehouse_ID string, Zone string, Aisle string, Storage_Type string, Bay int, Level int, Capacity_Units int",
    "sku_master": "SKU_ID string, Unit_Cost double, Unit_Price double",
}


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV table with a header, by name of a source table or by a schema of one's own. Columns are matched by the header's order."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("header", True).option("dateFormat", date_format).option("enforceSchema", False).csv(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite; array columns become JSON."""
    df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def json_list(column: str, of: str = "string"):
    """A JSON list from a CSV cell as an array."""
    return F.from_json(column, f"array<{of}>")


def records(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table; small by construction, so joins may broadcast it."""
    return spark.createDataFrame(rows, schema)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A rendered document (Markdown, say) as one file on any file system that Spark knows; replaces what is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of at most so many rows (a report, so it is for small results) as a Markdown section."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in df.limit(most).collect())]) + "\n"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or a temporary one where that is unset, as in tests."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="stockyard-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
