from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.operators import forecast as O
from stockyard.plans.catalog import query
from stockyard.plans.forecasting import panel_features

FEATURES = ["lag_1", "lag_7", "lag_14", "lag_28", "mean_7", "mean_14", "mean_28", "std_7", "weekday", "month", "quarter", "weekend", "since_big", "k_code"]
GRID = ((20, 3, 0.1), (20, 5, 0.1), (40, 3, 0.05), (40, 5, 0.05))


def _panel(spark, sf):
    p = panel_features(spark, sf)
    span = p.agg(F.max("date").alias("d1"))
    p = p.join(F.broadcast(span)).withColumn("train", F.datediff("d1", "date") >= 92)
    made = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(p).select("k", "date", "q", "train", "x").cache()
    few = _few(made).cache()
    few.count()
    made.unpersist()
    return few


def _few(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df in no more partitions than its rows need: each level of each tree is a job, so a partition of a few rows costs more than its work."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def _fit(df, iterations=20, depth=3, step=0.1):
    return GBTRegressor(featuresCol="x", labelCol="q", predictionCol="forecast", maxIter=iterations, maxDepth=depth, stepSize=step, seed=42).fit(df)


def _floored(df):
    return df.withColumn("forecast", F.greatest(F.lit(0.0), "forecast"))


@query("boosted_forecasts")
def boosted_forecasts(spark, sf):
    """One global model over all series, one day ahead (lags are realised values); floored at zero."""
    p = _panel(spark, sf)
    return _floored(_fit(p.filter("train")).transform(p.filter("not train"))).select("k", "date", "q", F.lit("GBT").alias("model"), "forecast")


@query("boosted_accuracy")
def boosted_accuracy(spark, sf):
    return O.accuracy(boosted_forecasts(spark, sf))


@query("feature_importance")
def feature_importance(spark, sf):
    m = _fit(_panel(spark, sf).filter("train"))
    rows = sorted(zip(FEATURES, m.featureImportances.toArray().tolist(), strict=True), key=lambda r: -r[1])[:15]
    return spark.createDataFrame(rows, "feature string, importance double")


@query("boosted_grid_cv")
def boosted_grid_cv(spark, sf):
    """iterations, depth, step, mean_rmse over three expanding windows cut by date, so no fold sees a later day."""
    panel = _panel(spark, sf)
    p = panel.filter("train")
    span = p.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    p = p.join(F.broadcast(span)).withColumn("fold", F.floor(4 * F.datediff("date", "a") / (F.datediff("b", "a") + 1))).drop("a", "b").cache()

    def rmse(point, f):
        it, depth, step = point
        e = _floored(_fit(p.filter(F.col("fold") < f), it, depth, step).transform(p.filter(F.col("fold") == f)))
        return it, depth, step, e.agg(F.sqrt(F.avg((F.col("forecast") - F.col("q")) ** 2)).alias("rmse")).first()["rmse"]

    # Fits are independent; each waits for small jobs one after another, so they run side by side.
    at_once = max(1, min(len(GRID) * 3, spark.sparkContext.defaultParallelism // p.rdd.getNumPartitions()))
    tasks = [inheritable_thread_target(spark)(partial(rmse, g, f)) for g in GRID[::-1] for f in (3, 2, 1)]  # the longest first
    with ThreadPool(at_once) as pool:
        found = pool.map(lambda task: task(), tasks, 1)
    p.unpersist()
    panel.unpersist()
    scores = spark.createDataFrame(found, "iterations int, depth int, step double, rmse double")  # a row for each point and fold
    return scores.groupBy("iterations", "depth", "step").agg(F.avg("rmse").alias("mean_rmse"))
