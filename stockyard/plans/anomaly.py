from pyspark.sql import functions as F

from stockyard.operators import anomaly as A
from stockyard.operators import control as C
from stockyard.operators import isolation
from stockyard.plans.catalog import query
from stockyard.plans.control import KPI, RULES, _CUSUM, LONG, based, kpis
from stockyard.sources import views as V

FEATURES = ["pick_accuracy", "error_rate", "mean_duration"]
KEY = ["warehouse", "date"]
OPERATOR_KEY = ["operator", "warehouse", "date"]
OPERATOR_FEATURES = ["tasks", "error_rate", "mean_duration"]


def _days(spark, sf):
    return kpis(spark, sf).dropna(subset=FEATURES)


def _lof(spark, sf):
    return A.lof(A.z_by_group(_days(spark, sf), FEATURES, ["warehouse"]), KEY, FEATURES, ["warehouse"])


_Z = "(({c} - avg({c}) OVER (PARTITION BY warehouse)) / stddev_pop({c}) OVER (PARTITION BY warehouse)) AS {c}"
LOF = f"""{KPI}, zz AS (SELECT warehouse, date, {', '.join(_Z.format(c=c) for c in FEATURES)} FROM kpi),
pr AS (SELECT a.warehouse, a.date AS a, b.date AS b, sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in FEATURES)}) AS d FROM zz a JOIN zz b ON a.warehouse = b.warehouse AND a.date <> b.date),
nn AS (SELECT *, row_number() OVER (PARTITION BY warehouse, a ORDER BY d, b) AS r FROM pr QUALIFY r <= 20), kd AS (SELECT warehouse, a AS b, d AS kd FROM nn WHERE r = 20),
re AS (SELECT warehouse, nn.a, nn.b, greatest(d, kd) AS reach FROM nn JOIN kd USING (warehouse, b)), lr AS (SELECT warehouse, a, 1 / (avg(reach) + 1e-10) AS lrd FROM re GROUP BY ALL),
lofs AS (SELECT re.warehouse, re.a AS date, avg(o.lrd) / any_value(l.lrd) AS lof FROM re JOIN lr o ON o.warehouse = re.warehouse AND o.a = re.b JOIN lr l ON l.warehouse = re.warehouse AND l.a = re.a GROUP BY re.warehouse, re.a),
lflag AS (SELECT warehouse, date, lof, lof > quantile_cont(lof, 0.95) OVER () AS lof_flag FROM lofs)"""


@query("lof_scores", f"WITH {LOF} SELECT warehouse, date, round(lof, 5) AS lof FROM lofs")
def lof_scores(spark, sf):
    return _lof(spark, sf).withColumn("lof", F.round("lof", 5))


@query("lof_flags", f"WITH {LOF} SELECT warehouse, date, lof_flag AS flag FROM lflag")
def lof_flags(spark, sf):
    return A.flag_share(_lof(spark, sf), "lof", 0.05).select("warehouse", "date", "flag")


def _forest(spark, sf, train=None):
    d = _days(spark, sf)
    return isolation.scores(A.z_by_group(d, FEATURES, ["warehouse"]) if train is None else d, KEY, FEATURES, train)


@query("isolation_scores")
def isolation_scores(spark, sf):
    return _forest(spark, sf)


@query("contamination_sweep")
def contamination_sweep(spark, sf):
    s = _forest(spark, sf)
    shares = (0.01, 0.03, 0.05, 0.10)
    cuts = s.agg(*[F.percentile("score", F.lit(1 - c)).alias(f"c{i}") for i, c in enumerate(shares)])
    flagged = s.join(F.broadcast(cuts)).select(*[(F.col("score") > F.col(f"c{i}")).alias(f"f{i}") for i in range(4)])
    return A.overlap(flagged, [("f0", "f1"), ("f1", "f2"), ("f2", "f3")])


def _operators(spark, sf):
    return C.operator_kpis(V.tasks(spark, sf)).withColumn("tasks", F.col("tasks").cast("double"))


@query("operator_isolation")
def operator_isolation(spark, sf):
    return isolation.scores_by_group(_operators(spark, sf), OPERATOR_KEY, OPERATOR_FEATURES, "warehouse")


@query(
    "operator_lof",
    """WITH ok AS (SELECT operator, warehouse, date, count(*)::DOUBLE AS tasks, sum(error) / count(*) AS error_rate, CAST(sum(duration) AS DOUBLE) / count(*) AS mean_duration FROM tasks GROUP BY operator, warehouse, date HAVING count(*) >= 5),
zz AS (SELECT operator, warehouse, date, """
    + ", ".join(_Z.format(c=c) for c in OPERATOR_FEATURES)
    + """ FROM ok), pr AS (SELECT a.warehouse, a.operator AS ao, a.date AS ad, b.operator AS bo, b.date AS bd, sqrt((a.tasks-b.tasks)**2 + (a.error_rate-b.error_rate)**2 + (a.mean_duration-b.mean_duration)**2) AS d FROM zz a JOIN zz b ON a.warehouse = b.warehouse AND (a.operator <> b.operator OR a.date <> b.date)),
nn AS (SELECT *, row_number() OVER (PARTITION BY warehouse, ao, ad ORDER BY d, bo, bd) AS r FROM pr QUALIFY r <= 20), kd AS (SELECT warehouse, ao AS bo, ad AS bd, d AS kd FROM nn WHERE r = 20),
re AS (SELECT warehouse, ao, ad, nn.bo, nn.bd, greatest(d, kd) AS reach FROM nn JOIN kd USING (warehouse, bo, bd)), lr AS (SELECT warehouse, ao, ad, 1 / (avg(reach) + 1e-10) AS lrd FROM re GROUP BY ALL)
SELECT re.ao AS operator, re.warehouse, re.ad AS date, round(avg(o.lrd) / any_value(l.lrd), 4) AS lof FROM re JOIN lr o ON o.warehouse = re.warehouse AND o.ao = re.bo AND o.ad = re.bd JOIN lr l ON l.warehouse = re.warehouse AND l.ao = re.ao AND l.ad = re.ad GROUP BY ALL""",
)
def operator_lof(spark, sf):
    z = A.z_by_group(_operators(spark, sf), OPERATOR_FEATURES, ["warehouse"])
    return A.lof(z, OPERATOR_KEY, OPERATOR_FEATURES, ["warehouse"]).select("operator", "warehouse", "date", F.round("lof", 4).alias("lof"))


@query("unified_scores")
def unified_scores(spark, sf):
    """entity, date, method, level, score: all detectors in one table."""
    day = _forest(spark, sf).select(F.col("warehouse").cast("string").alias("entity"), "date", F.lit("IF").alias("method"), F.lit("warehouse").alias("level"), "score")
    lof = _lof(spark, sf).select(F.col("warehouse").cast("string").alias("entity"), "date", F.lit("LOF").alias("method"), F.lit("warehouse").alias("level"), F.col("lof").alias("score"))
    op = operator_isolation(spark, sf).select(F.concat_ws("@", "operator", "warehouse").alias("entity"), "date", F.lit("IF").alias("method"), F.lit("operator").alias("level"), "score")
    return day.unionByName(lof).unionByName(op)


def flags(spark, sf):
    """warehouse, date, spc, lof: left joins that share one partitioning."""
    b = based(spark, sf)
    spc = C.anomalies(C.run_rules(b), C.cusum(b)).select("warehouse", "date").distinct().withColumn("spc", F.lit(True))
    lof = A.flag_share(_lof(spark, sf), "lof", 0.05).select("warehouse", "date", F.col("flag").alias("lof"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return kpis(spark, sf).select("warehouse", "date", "volume").join(spc, KEY, "left").join(lof, KEY, "left").select(*KEY, no("spc").alias("spc"), no("lof").alias("lof"), (F.col("volume") > 120).alias("busy"))


_FLAGS = f"""{RULES}, {_CUSUM[len(LONG) + 2:]}, {LOF[len(KPI) + 2:]}, spcd AS (SELECT DISTINCT warehouse, date FROM (SELECT warehouse, date FROM ruled WHERE rule1 OR rule2 OR rule3 OR rule4 UNION SELECT warehouse, date FROM sums WHERE alarm)),
fl AS (SELECT k.warehouse, k.date, s.date IS NOT NULL AS spc, coalesce(lof_flag, false) AS lof, k.volume > 120 AS busy FROM kpi k LEFT JOIN spcd s USING (warehouse, date) LEFT JOIN lflag l USING (warehouse, date))"""


@query("flag_matrix", f"WITH RECURSIVE {_FLAGS} SELECT *, CASE spc::INT + lof::INT + busy::INT WHEN 3 THEN 'all' WHEN 2 THEN 'partial' WHEN 1 THEN 'single' ELSE 'none' END AS agreement FROM fl")
def flag_matrix(spark, sf):
    return flags(spark, sf).withColumn("agreement", A.agreement_label([F.col("spc"), F.col("lof"), F.col("busy")]))


@query("detector_overlap", f"""WITH RECURSIVE {_FLAGS}, lo AS (SELECT 'spc' AS a, 'lof' AS b, spc AS x, lof AS y FROM fl UNION ALL SELECT 'spc', 'busy', spc, busy FROM fl UNION ALL SELECT 'lof', 'busy', lof, busy FROM fl), c AS (SELECT a, b, count_if(x AND y) AS "both", count_if(x AND NOT y) AS only_a, count_if(y AND NOT x) AS only_b, count(*) AS n FROM lo GROUP BY a, b), q AS (SELECT *, (n - only_a - only_b) / n AS po, ("both" + only_a) / n * (("both" + only_b) / n) + (1 - ("both" + only_a) / n) * (1 - ("both" + only_b) / n) AS pe FROM c) SELECT a, b, "both", only_a, only_b, round(CASE WHEN "both" + only_a + only_b > 0 THEN "both" / ("both" + only_a + only_b) ELSE 0 END, 6) AS jaccard, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM q""", long="both only_a only_b")
def detector_overlap(spark, sf):
    return A.overlap(flags(spark, sf), [("spc", "lof"), ("spc", "busy"), ("lof", "busy")]).withColumns({c: F.round(c, 6) for c in ("jaccard", "kappa")})


@query("spc_only_assessment", f"WITH RECURSIVE {_FLAGS}, o AS (SELECT fl.warehouse, fl.date, strftime(fl.date, '%A') AS weekday, abs(b.x - mu) / nullif(sd, 0) AS z FROM fl JOIN based b ON b.warehouse = fl.warehouse AND b.date = fl.date AND metric = 'pick_accuracy' WHERE spc AND NOT lof ORDER BY fl.date, fl.warehouse LIMIT 10) SELECT warehouse, date, weekday, CASE WHEN z IS NULL THEN 'insufficient baseline data' WHEN z < 3.5 THEN 'likely benign (threshold proximity)' ELSE 'possible true anomaly' END AS assessment FROM o")
def spc_only_assessment(spark, sf):
    f = flags(spark, sf).filter("spc and not lof")
    b = based(spark, sf).filter("metric = 'pick_accuracy'").select(*KEY, (F.abs(F.col("x") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"))
    a = F.when(F.col("z").isNull(), "insufficient baseline data").when(F.col("z") < 3.5, "likely benign (threshold proximity)").otherwise("possible true anomaly")
    return f.join(b, KEY).orderBy("date", "warehouse").limit(10).select(*KEY, F.date_format("date", "EEEE").alias("weekday"), a.alias("assessment"))


@query("historic_fit_coverage")
def historic_fit_coverage(spark, sf):
    """Fit on the first 20 days, score later ones; how many of the full fit's flags the historic fit finds."""
    d = _days(spark, sf)
    first = d.agg(F.min("date").alias("d0"))
    d = d.join(F.broadcast(first))
    old = d.filter(F.datediff("date", "d0") < 20)
    stats = old.agg(*[x for c in FEATURES for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    scaled = lambda x: x.join(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in FEATURES})
    late = scaled(d.filter(F.datediff("date", "d0") >= 20))
    hist = A.flag_share(isolation.scores(late, KEY, FEATURES, scaled(old)), "score", 0.05).select(*KEY, F.col("flag").alias("h"))
    full = A.flag_share(isolation.scores(late, KEY, FEATURES), "score", 0.05).select(*KEY, F.col("flag").alias("f"))
    return hist.join(full, KEY).agg(F.count_if("f").alias("full"), F.count_if("h").alias("historic"), F.count_if(F.col("f") & F.col("h")).alias("both")).withColumn("coverage", F.col("both") / F.nullif(F.col("full"), F.lit(0)))

