"""Cost models and decisions. Where a published rule is at odds with its own words, both figures stand side by side in named columns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.plans.catalog import query
from stockyard.plans.segmentation import _CLASSES, _FEATURES, _SIMPLE, classes
from stockyard.plans.warehouse import _STAB, _stability
from stockyard.sources import views as V
from stockyard.sources.files import records

RATE = 0.10
#: Segmentation methods: seconds a run, runs a year, maintenance scores (fixed values).
_SEG = [("Rule-Based (ABC/XYZ)", 2.0, 12, 3.0), ("K-Means Clustering", 40.0, 12, 2.75)]
#: Forecast models: training seconds a sku, mean maintenance score (fixed values).
_FC = [("Naive", 0.001, 2.0), ("SeasonalNaive", 0.001, 2.0), ("SES", 0.05, 2.5), ("ARIMA", 8.0, 3.0), ("SARIMA", 15.0, 3.75), ("XGBoost", 30.0 / 1664, 3.0), ("LightGBM", 20.0 / 1664, 3.0), ("Croston", 0.01, 2.25)]
#: Published errors of those models, as inputs (fixed values).
_MAPE = [("Naive", 79.9), ("SeasonalNaive", 83.8), ("SES", 66.5), ("ARIMA", 80.3), ("SARIMA", 80.3), ("XGBoost", 57.5), ("LightGBM", 57.4), ("Croston", 70.2)]
#: Monitoring methods: seconds a day, share of false alarms, flags in two years (fixed values).
_MON = [("SPC (control charts + CUSUM)", 0.15, 0.60, 243), ("Isolation Forest (warehouse)", 2.10, 0.20, 110), ("LOF (warehouse)", 3.00, 0.20, 110), ("IF (operator level)", 15.00, 0.20, 182), ("Hybrid (SPC daily + IF weekly)", 0.15 + 2.10 / 7, 0.40, 176)]


def _values(rows):
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query("segmentation_costs", f"WITH m(method, s, runs, score) AS (VALUES {_values(_SEG)}) SELECT method, round({RATE}::DOUBLE * s * (SELECT count(DISTINCT sku) FROM demand) / 1664 / 3600 * runs, 8) AS annual_compute, score * 50 * 4 * 4 AS annual_maintenance FROM m")
def segmentation_costs(spark, sf):
    """The published seconds are for 1,664 skus; those of the tables take their share."""
    m = records(spark, _SEG, "method string, s double, runs int, score double").join(F.broadcast(_skus(spark, sf)))
    return m.select("method", F.round(RATE * F.col("s") * F.col("skus") / 1664 / 3600 * F.col("runs"), 8).alias("annual_compute"), (F.col("score") * 50 * 4 * 4).alias("annual_maintenance"))


_VALUE = f"{_FEATURES}, {_CLASSES}, {_SIMPLE}, q AS (SELECT cls.*, stockout_rate, CAST((4 * row_number() OVER (ORDER BY mean_demand, sku) + count(*) OVER () - 1) // count(*) OVER () AS INT) AS tier FROM cls JOIN tot USING (sku)), v AS (SELECT count_if(abc = 'A' AND tier <= 2) AS n_misclassified, avg(total_revenue) FILTER (abc = 'A' AND tier <= 2) AS r, avg(stockout_rate) FILTER (abc = 'A' AND tier <= 2) AS s, count_if(abc = 'C' AND tier > 2) AS n_underrated FROM q)"


def _value(spark, sf):
    from stockyard.operators import panel as P

    rate = V.facts(spark, sf).groupBy("sku").agg(F.avg("stockout").alias("stockout_rate"))
    q = classes(spark, sf).join(rate, "sku").withColumn("tier", P.first_rank_quintile(F.col("mean_demand"), "sku", 4))
    low = (F.col("abc") == "A") & (F.col("tier") <= 2)
    v = q.agg(F.count_if(low).alias("n_misclassified"), F.avg(F.when(low, F.col("total_revenue"))).alias("r"), F.avg(F.when(low, F.col("stockout_rate"))).alias("s"), F.count_if((F.col("abc") == "C") & (F.col("tier") > 2)).alias("n_underrated"))
    return v.withColumn("captured", F.coalesce(F.col("n_misclassified") * F.col("r") * F.col("s") * 0.10, F.lit(0.0)))


@query("segmentation_value", f"WITH {_VALUE} SELECT n_misclassified, n_underrated, round(coalesce(n_misclassified * r * s * 0.10::DOUBLE, 0), 3) AS captured, round(coalesce(n_misclassified * r * s * 0.10::DOUBLE, 0) - ({RATE}::DOUBLE * 38 / 3600 * 12) + 0.25 * 800, 3) AS net FROM v", long="n_misclassified n_underrated")
def segmentation_value(spark, sf):
    v = _value(spark, sf)
    return v.select("n_misclassified", "n_underrated", F.round("captured", 3).alias("captured"), F.round(F.col("captured") - RATE * 38 / 3600 * 12 + 0.25 * 800, 3).alias("net"))


_GATES = [("all pass", 0.53, 0.9989, 100.0), ("weak clusters", 0.45, 0.99, 100.0), ("no value", 0.53, 0.99, -1.0), ("unstable", 0.53, 0.80, 100.0)]


@query("segmentation_gates", f"WITH g(c, sil, ari, v) AS (VALUES {_values(_GATES)}) SELECT c AS case_name, ari >= 0.95 AS stable, CASE WHEN sil > 0.5 AND ari > 0.95 AND v > 0 THEN 'DEPLOY' WHEN (sil > 0.5)::INT + (ari > 0.95)::INT + (v > 0)::INT = 2 THEN 'HYBRID' ELSE 'RULE-ONLY' END AS decision FROM g")
def segmentation_gates(spark, sf):
    g = records(spark, _GATES, "case_name string, sil double, ari double, v double")
    a, b, c = F.col("sil") > 0.5, F.col("ari") > 0.95, F.col("v") > 0
    return g.select("case_name", (F.col("ari") >= 0.95).alias("stable"), F.when(a & b & c, "DEPLOY").when(a.cast("int") + b.cast("int") + c.cast("int") == 2, "HYBRID").otherwise("RULE-ONLY").alias("decision"))


_FCSQL = f"m(model, s, score) AS (VALUES {_values(_FC)}), e(model, mape) AS (VALUES {_values(_MAPE)}), c AS (SELECT model, s * (SELECT count(DISTINCT sku) FROM demand) / 3600 * 4 * {RATE}::DOUBLE AS cost, score, mape FROM m JOIN e USING (model)), d AS (SELECT *, (SELECT mape FROM c WHERE model = 'Naive') - mape AS gain, cost - (SELECT cost FROM c WHERE model = 'Naive') AS more FROM c), p AS (SELECT *, gain / greatest(more, 0.001::DOUBLE) AS per_dollar FROM d)"


def _skus(spark, sf):
    """One row: skus, those that have demand."""
    return V.demand(spark, sf).agg(F.count_distinct("sku").alias("skus"))


def _fc(spark, sf):
    """Costs of training for all skus of the tables, published errors, gains against the naive forecast."""
    m = records(spark, _FC, "model string, s double, score double").join(records(spark, _MAPE, "model string, mape double"), "model")
    c = m.join(F.broadcast(_skus(spark, sf))).select("model", (F.col("s") * F.col("skus") / 3600 * 4 * RATE).alias("cost"), "score", "mape")
    base = c.filter("model = 'Naive'").select(F.col("mape").alias("bm"), F.col("cost").alias("bc"))
    return c.join(F.broadcast(base)).withColumn("gain", F.col("bm") - F.col("mape")).withColumn("per_dollar", F.col("gain") / F.greatest(F.col("cost") - F.col("bc"), F.lit(0.001)))


@query("forecast_costs", f"WITH {_FCSQL} SELECT model, round(cost, 6) AS monthly_cost, score, mape, round(gain, 4) AS gain, round(per_dollar, 3) AS per_dollar FROM p")
def forecast_costs(spark, sf):
    return _fc(spark, sf).select("model", F.round("cost", 6).alias("monthly_cost"), "score", "mape", F.round("gain", 4).alias("gain"), F.round("per_dollar", 3).alias("per_dollar"))


@query("forecast_choices", f"WITH {_FCSQL} SELECT 'A' AS class, (SELECT model FROM p WHERE per_dollar > 0 ORDER BY mape, model LIMIT 1) AS model UNION ALL SELECT 'B', (SELECT model FROM p WHERE per_dollar > 0 ORDER BY per_dollar DESC, model LIMIT 1) UNION ALL SELECT 'C', (SELECT model FROM p WHERE mape <= (SELECT min(mape) FROM p) + 5 ORDER BY cost, model LIMIT 1)")
def forecast_choices(spark, sf):
    """Best error for A, most gain a dollar for B, cheapest within five points of the best for C."""
    p = _fc(spark, sf).withColumn("best", F.min("mape").over(Window.partitionBy()))
    worth = F.col("per_dollar") > 0
    g = p.agg(F.min_by(F.when(worth, F.col("model")), F.when(worth, F.struct("mape", "model"))).alias("A"), F.min_by(F.when(worth, F.col("model")), F.when(worth, F.struct(-F.col("per_dollar"), "model"))).alias("B"), F.min_by("model", F.when(F.col("mape") <= F.col("best") + 5, F.struct("cost", "model"))).alias("C"))
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("model")) for c in "ABC"])).alias("x")).select("x.*")


@query("forecast_pareto", f"WITH {_FCSQL}, q AS (SELECT *, min(mape) OVER (ORDER BY cost, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT model, round(cost, 6) AS monthly_cost, mape FROM q WHERE before IS NULL OR mape < before")
def forecast_pareto(spark, sf):
    w = Window.orderBy("cost", "model").rowsBetween(Window.unboundedPreceding, -1)
    return _fc(spark, sf).withColumn("before", F.min("mape").over(w)).filter(F.col("before").isNull() | (F.col("mape") < F.col("before"))).select("model", F.round("cost", 6).alias("monthly_cost"), "mape")


@query("forecast_decision", f"WITH {_FEATURES}, {_CLASSES}, {_FCSQL}, n AS (SELECT abc, count(*) AS n_skus, sum(count(*)) OVER () AS total FROM cls GROUP BY abc) SELECT abc, n_skus, CASE WHEN abc = 'C' AND (SELECT mape FROM p WHERE model = 'SES') - (SELECT mape FROM p WHERE model = 'LightGBM') <= 5 THEN 'SES' ELSE 'LightGBM' END AS model, round((SELECT cost FROM p WHERE model = 'LightGBM') * n_skus / total, 8) AS monthly_cost FROM n")
def forecast_decision(spark, sf):
    n = classes(spark, sf).groupBy("abc").agg(F.count("*").alias("n_skus")).withColumn("total", F.sum("n_skus").over(Window.partitionBy()))
    p = _fc(spark, sf).agg(F.max(F.when(F.col("model") == "SES", F.col("mape"))).alias("ses"), F.max(F.when(F.col("model") == "LightGBM", F.col("mape"))).alias("lgb"), F.max(F.when(F.col("model") == "LightGBM", F.col("cost"))).alias("c"))
    return n.join(F.broadcast(p)).select("abc", "n_skus", F.when((F.col("abc") == "C") & (F.col("ses") - F.col("lgb") <= 5), "SES").otherwise("LightGBM").alias("model"), F.round(F.col("c") * F.col("n_skus") / F.col("total"), 8).alias("monthly_cost"))


#: Path methods: seconds a session, distance saved in per cent; slotting methods: seconds a sku, travel saved in per cent (fixed values).
_PATH = [("Naive (current)", 0.00001, 0.0), ("Nearest-Neighbor", 0.00005, 47.5), ("2-Opt", 0.00034, 49.8), ("Exact TSP (up to 8 stops)", 0.1, 50.8)]
_SLOT = [("Greedy Slotting", 0.001, 0.38), ("LP Joint Slotting", 0.5, 1.52), ("Affinity-Aware Greedy", 0.002, 0.304)]


@query("path_costs", f"WITH m(method, s, pct) AS (VALUES {_values(_PATH)}) SELECT method, round(45000 * s / 3600 * {RATE}::DOUBLE, 6) AS monthly_compute, round(45000 * s * {RATE}::DOUBLE, 4) AS monthly_compute_as_published, round(547500 * pct / 100 * 0.5::DOUBLE * 18, 2) AS annual_saving FROM m")
def path_costs(spark, sf):
    """The published figures charge the hourly rate by the second; the corrected ones stand beside them."""
    m = records(spark, _PATH, "method string, s double, pct double")
    return m.select("method", F.round(45000 * F.col("s") / 3600 * RATE, 6).alias("monthly_compute"), F.round(45000 * F.col("s") * RATE, 4).alias("monthly_compute_as_published"), F.round(547500 * F.col("pct") / 100 * 0.5 * 18, 2).alias("annual_saving"))


_SLOTSQL = f"{_STAB}, mv AS (SELECT avg(pct_changed) AS pct_moved FROM st), m(method, s, pct) AS (VALUES {_values(_SLOT)}), sl AS (SELECT method, 1664 * s / 3600 * {RATE}::DOUBLE AS compute, 547500 * pct / 100 * 0.5::DOUBLE * 18 AS saving, pct_moved / 100 * 1664 * 0.25::DOUBLE * 25 * 12 AS labour FROM m, mv)"


def _slotting(spark, sf):
    m = records(spark, _SLOT, "method string, s double, pct double").join(F.broadcast(_stability(spark, sf).agg(F.avg("pct_changed").alias("moved"))))
    return m.select("method", (1664 * F.col("s") / 3600 * RATE).alias("compute"), (547500 * F.col("pct") / 100 * 0.5 * 18).alias("saving"), (F.col("moved") / 100 * 1664 * 0.25 * 25 * 12).alias("labour"))


@query("slotting_costs", f"WITH {_SLOTSQL} SELECT method, round(compute, 6) AS monthly_compute, round(saving, 2) AS annual_saving, round(labour, 2) AS annual_labour, round(saving - compute * 12 - labour, 2) AS net FROM sl")
def slotting_costs(spark, sf):
    return _slotting(spark, sf).select("method", F.round("compute", 6).alias("monthly_compute"), F.round("saving", 2).alias("annual_saving"), F.round("labour", 2).alias("annual_labour"), F.round(F.col("saving") - F.col("compute") * 12 - F.col("labour"), 2).alias("net"))


@query("warehouse_decision", f"WITH {_SLOTSQL}, n AS (SELECT 547500 * 49.8::DOUBLE / 100 * 0.5 * 18 + saving AS saving, compute * 12 + labour + 45000 * 0.00034::DOUBLE / 3600 * {RATE}::DOUBLE * 12 AS cost FROM sl WHERE method = 'LP Joint Slotting') SELECT round(saving, 2) AS annual_saving, round(cost, 2) AS annual_cost, round(200000 / ((saving - cost) / 12), 4) AS payback_months FROM n")
def warehouse_decision(spark, sf):
    n = _slotting(spark, sf).filter("method = 'LP Joint Slotting'").select((547500 * 49.8 / 100 * 0.5 * 18 + F.col("saving")).alias("saving"), (F.col("compute") * 12 + F.col("labour") + 45000 * 0.00034 / 3600 * RATE * 12).alias("cost"))
    return n.select(F.round("saving", 2).alias("annual_saving"), F.round("cost", 2).alias("annual_cost"), F.round(200000 / ((F.col("saving") - F.col("cost")) / 12), 4).alias("payback_months"))


@query("monitoring_costs", f"WITH m(method, s, fp, flags) AS (VALUES {_values(_MON)}) SELECT method, round(s * 30 / 3600 * {RATE}::DOUBLE * 12, 6) AS annual_compute, round(flags / 2 * fp * 10, 2) AS annual_false_alarms, round(flags / 2 * 12 * fp * 10, 2) AS annual_false_alarms_as_published FROM m")
def monitoring_costs(spark, sf):
    """Flags of two years halved are a year's; the published figures multiply by twelve once more. Each method has its own row and rate."""
    m = records(spark, _MON, "method string, s double, fp double, flags int")
    return m.select("method", F.round(F.col("s") * 30 / 3600 * RATE * 12, 6).alias("annual_compute"), F.round(F.col("flags") / 2 * F.col("fp") * 10, 2).alias("annual_false_alarms"), F.round(F.col("flags") / 2 * 12 * F.col("fp") * 10, 2).alias("annual_false_alarms_as_published"))


@query("incident_value", "SELECT 0.02::DOUBLE * 500 * 7 * 25 AS cost_per_incident, 0.02::DOUBLE * 500 * 7 * 25 * 4 * 3 AS annual_value")
def incident_value(spark, sf):
    return spark.range(1).select((F.lit(0.02) * 500 * 7 * 25).alias("cost_per_incident"), (F.lit(0.02) * 500 * 7 * 25 * 4 * 3).alias("annual_value"))


@query("monitoring_layers", f"WITH m(method, s, fp, flags) AS (VALUES {_values(_MON)}), t AS (SELECT method, s * 30 / 3600 * {RATE}::DOUBLE * 12 + flags / 2 * fp * 10 AS total FROM m) SELECT CASE WHEN method LIKE 'SPC%' THEN 1 WHEN method LIKE 'Isolation%' THEN 2 ELSE 3 END AS layer, method, round(total, 3) AS annual_total FROM t WHERE method NOT LIKE 'Hybrid%' AND method NOT LIKE 'LOF%'")
def monitoring_layers(spark, sf):
    m = records(spark, _MON, "method string, s double, fp double, flags int")
    total = F.col("s") * 30 / 3600 * RATE * 12 + F.col("flags") / 2 * F.col("fp") * 10
    layer = F.when(F.col("method").startswith("SPC"), 1).when(F.col("method").startswith("Isolation"), 2).otherwise(3)
    return m.filter(~F.col("method").startswith("Hybrid") & ~F.col("method").startswith("LOF")).select(layer.alias("layer"), "method", F.round(total, 3).alias("annual_total"))

