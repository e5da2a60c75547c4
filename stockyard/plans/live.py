from pyspark.sql import functions as F

from stockyard.plans.catalog import query
from stockyard.sources import files
from stockyard.streaming import kpi


@query("stream_hourly_kpis", "WITH w AS (SELECT user_id % 3 AS warehouse, date_trunc('hour', ts) AS s, count(*) AS n, count_if(event_type = 'error') AS errors, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY ALL) SELECT warehouse, strftime(s, '%Y-%m-%d %H:00') AS hour, n, errors, CAST(total AS DOUBLE) AS total FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR", long="errors")
def stream_hourly_kpis(spark, sf):
    out = files.scratch(spark, "hourly")
    kpi.write_closed(kpi.hourly(kpi.read_events(spark, sf)), f"{out}/data", f"{out}/state")
    d = spark.read.parquet(f"{out}/data")
    return d.select("warehouse", F.date_format("start", "yyyy-MM-dd HH:00").alias("hour"), "n", "errors", F.col("total").cast("double").alias("total"))
