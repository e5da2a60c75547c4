import datetime

from pyspark.sql import functions as F

from stockyard.operators import experiment as X
from stockyard.plans.catalog import normal_cdf, query
from stockyard.plans.rfm import _SCORED, _segments
from stockyard.sources import views as V

D = datetime.date
NOW, BEFORE = (D(2001, 5, 1), D(2001, 7, 31)), (D(2000, 8, 1), D(2001, 4, 30))
_CONV = f"""{_SCORED}, cn AS (SELECT customer, count_if(date BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}') AS orders_now, count_if(date BETWEEN DATE '{BEFORE[0]}' AND DATE '{BEFORE[1]}') / 3 AS rate_before FROM sales GROUP BY customer),
cv AS (SELECT customer, coalesce(orders_now, 0) AS orders_now, coalesce(rate_before, 0) AS rate_before, (coalesce(orders_now, 0) - coalesce(rate_before, 0)) / (coalesce(rate_before, 0) + 1e-9::DOUBLE) AS change FROM seg LEFT JOIN cn USING (customer) WHERE segment = 'At Risk')"""


def _at_risk(spark, sf):
    return _segments(spark, sf).filter("segment = 'At Risk'").select("customer")


def _conversion(spark, sf):
    return X.conversion(V.sales(spark, sf), _at_risk(spark, sf), NOW, BEFORE)


@query("conversion", f"WITH {_CONV} SELECT customer, orders_now, round(rate_before, 6) AS rate_before, CASE WHEN change >= -0.2::DOUBLE THEN 1 ELSE 0 END AS converted FROM cv", long="orders_now")
def conversion(spark, sf):
    return _conversion(spark, sf).select("customer", "orders_now", F.round("rate_before", 6).alias("rate_before"), "converted")


#: Standard normal quantiles at 0.975 and 0.8.
_ZA, _ZB = "1.959963984540054::DOUBLE", "0.8416212335729143::DOUBLE"


@query("power_analysis", f"WITH {_CONV}, b AS (SELECT least(greatest(avg(CASE WHEN change >= -0.2::DOUBLE THEN 1 ELSE 0 END), 0.01::DOUBLE), 0.94::DOUBLE) AS p, count(*) AS n FROM cv), h AS (SELECT *, 2 * asin(sqrt(p)) - 2 * asin(sqrt(least(p + 0.05::DOUBLE, 0.999::DOUBLE))) AS h FROM b), r AS (SELECT *, CAST(ceil(2 * (({_ZA} + {_ZB}) / h) ** 2) AS BIGINT) AS need FROM h), u AS (SELECT *, least(need, n // 2) AS used FROM r) SELECT round(p, 6) AS baseline_rate, 0.05::DOUBLE AS mde, round(h, 6) AS effect, need AS required_n, CAST(used AS BIGINT) AS used_n, CAST(n AS BIGINT) AS available, n >= 2 * need AS feasible, round(greatest(0.001::DOUBLE, sin(asin(sqrt(p)) + ({_ZA} + {_ZB}) * sqrt(2 / greatest(used, 1)::DOUBLE) / 2) ** 2 - p), 6) AS detectable_mde, 0.05::DOUBLE AS alpha, 0.8::DOUBLE AS power FROM u")
def power_analysis(spark, sf):
    r = _conversion(spark, sf).agg(F.avg("converted").alias("p"), F.count("*").alias("n")).first()
    d = X.power_analysis(min(max(r.p, 0.01), 0.94), r.n)
    d |= {k: round(d[k], 6) for k in ("baseline_rate", "effect", "detectable_mde")}
    return spark.createDataFrame([tuple(d.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'bigint' if isinstance(v, int) else 'double'}" for k, v in d.items()))


@query("cost_scenarios", f"WITH {_SCORED}, a AS (SELECT count(*) AS n FROM seg WHERE segment = 'At Risk'), o AS (SELECT CAST(sum(revenue) AS DOUBLE) / count(*) AS aov FROM sales JOIN seg USING (customer) WHERE segment = 'At Risk'), k(scenario, m) AS (VALUES ('Pessimistic', 0.5::DOUBLE), ('Realistic', 1::DOUBLE), ('Optimistic', 2::DOUBLE)) SELECT scenario, round(0.1::DOUBLE * m, 6) AS lift, round(n * 0.1::DOUBLE * m, 4) AS orders, round(n * 0.1::DOUBLE * m * aov, 2) AS revenue, round(n * 8.0::DOUBLE, 2) AS cost, round(100 * (n * 0.1::DOUBLE * m * aov - n * 8) / (n * 8), 3) AS roi_pct FROM a, o, k")
def cost_scenarios(spark, sf):
    at = _at_risk(spark, sf)
    o = V.sales(spark, sf).join(at, "customer", "left_semi").agg((F.sum("revenue").cast("double") / F.count("*")).alias("aov"))
    s = at.agg(F.count("*").alias("n")).join(F.broadcast(o)).select(F.explode(X.scenarios(F.lit(0.1), F.col("n"), F.col("aov"))).alias("s")).select("s.*")
    return s.select("scenario", F.round("lift", 6).alias("lift"), F.round("orders", 4).alias("orders"), F.round("revenue", 2).alias("revenue"), F.round("cost", 2).alias("cost"), F.round("roi_pct", 3).alias("roi_pct"))


def _assigned(spark, sf, per_arm=47):
    c = V.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("type"))
    return X.assign(_at_risk(spark, sf).join(c, "customer"), "type", per_arm)


@query("assignment", f"WITH {_SCORED}, a AS (SELECT customer, c_mktsegment AS type FROM seg JOIN customer ON c_custkey = customer WHERE segment = 'At Risk'), b AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY substr(md5(customer || ':42'), 1, 15), customer) AS r, count(*) OVER (PARTITION BY type) AS n, count(*) OVER () AS total FROM a), t AS (SELECT *, least(round_even(n * PER_ARM / total, 0), n) AS treat FROM b), d AS (SELECT customer, type, r, CASE WHEN r <= treat THEN 'Treatment' WHEN r <= treat + least(treat, n - treat) THEN 'Control' END AS arm FROM t) SELECT customer, type, arm FROM d WHERE arm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm ORDER BY type, r) <= PER_ARM".replace("PER_ARM", "47"))
def assignment(spark, sf):
    return _assigned(spark, sf)


@query("assignment_balance", f"WITH {_SCORED}, a AS (SELECT c_mktsegment AS type, count(*) AS n, sum(count(*)) OVER () AS total FROM seg JOIN customer ON c_custkey = customer WHERE segment = 'At Risk' GROUP BY c_mktsegment), t AS (SELECT type, n, CASE WHEN abs(n * 20 / total - floor(n * 20 / total) - 0.5) < 1e-12 THEN 2 * round(n * 20 / total / 2) ELSE round(n * 20 / total) END AS treat FROM a), u AS (SELECT type, treat, least(treat, n - treat) AS control, sum(treat) OVER (ORDER BY type) AS st, sum(least(treat, n - treat)) OVER (ORDER BY type) AS sc FROM t) SELECT type, CAST(greatest(0, least(treat, 20 - (st - treat))) AS BIGINT) AS \"Treatment\", CAST(greatest(0, least(control, 20 - (sc - control))) AS BIGINT) AS \"Control\" FROM u")
def assignment_balance(spark, sf):
    return _assigned(spark, sf, 20).groupBy("type").pivot("arm", ["Treatment", "Control"]).count().fillna(0)


def _outcome(spark, sf):
    c = _conversion(spark, sf)
    arm = F.when(F.col("customer") % 2 == 0, "Treatment").otherwise("Control")
    return c.withColumn("arm", arm)


_OUT = f"{_CONV}, oc AS (SELECT CASE WHEN customer % 2 = 0 THEN 'Treatment' ELSE 'Control' END AS arm, CASE WHEN change >= -0.2::DOUBLE THEN 1 ELSE 0 END AS converted, customer FROM cv), s AS (SELECT sum(converted) FILTER (arm = 'Treatment')::DOUBLE AS x1, count(*) FILTER (arm = 'Treatment')::DOUBLE AS n1, sum(converted) FILTER (arm = 'Control')::DOUBLE AS x2, count(*) FILTER (arm = 'Control')::DOUBLE AS n2 FROM oc), z AS (SELECT *, x1 / n1 AS p1, x2 / n2 AS p2, (x1 + x2) / (n1 + n2) AS p FROM s)"


def _z(spark, sf):
    t = F.col("arm") == "Treatment"
    s = _outcome(spark, sf).agg(F.sum(F.when(t, F.col("converted"))).cast("double").alias("x1"), F.count_if(t).cast("double").alias("n1"), F.sum(F.when(~t, F.col("converted"))).cast("double").alias("x2"), F.count_if(~t).cast("double").alias("n2"))
    return s.select("n1", "n2", X.two_proportions(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")).alias("r")).select("n1", "n2", "r.*")


@query("two_proportion_z", f"WITH {_OUT} SELECT round(p1, 6) AS p1, round(p2, 6) AS p2, round(p1 - p2, 6) AS diff, round((p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 5) AS z, round(p1 - p2 - 1.96::DOUBLE * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 6) AS low, round(p1 - p2 + 1.96::DOUBLE * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), 6) AS high FROM z")
def two_proportion_z(spark, sf):
    return _z(spark, sf).select(*[F.round(c, 5 if c == "z" else 6).alias(c) for c in ("p1", "p2", "diff", "z", "low", "high")])


@query("experiment_p_values", f"WITH {_OUT}, y AS (SELECT (p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z, abs(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2))) AS h, n1 FROM z), x AS (SELECT *, h * sqrt(n1 / 2) AS s FROM y) SELECT round(z, 5) AS z, round(2 - 2 * {normal_cdf('abs(z)')}, 6) AS p, CASE WHEN h > 1e-6 THEN round({normal_cdf(f's - {_ZA}')} + {normal_cdf(f'-s - {_ZA}')}, 6) ELSE 0 END AS power FROM x")
def experiment_p_values(spark, sf):
    return _z(spark, sf).select(F.round("z", 5).alias("z"), F.round(X.normal_p("z"), 6).alias("p"), F.round(X.post_hoc_power("p1", "p2", "n1"), 6).alias("power"))


@query("test_design", f"WITH {_SCORED}, a AS (SELECT count(*) AS n FROM seg WHERE segment = 'At Risk') SELECT 'At Risk' AS population, n AS available, 'customer' AS unit, 'stratified by type' AS assignment, 'converted' AS primary_metric, 'mean order value' AS guardrail, DATE '{BEFORE[0]}' AS baseline_from, DATE '{BEFORE[1]}' AS baseline_to, DATE '{NOW[0]}' AS test_from, DATE '{NOW[1]}' AS test_to, 0.05::DOUBLE AS alpha, 0.8::DOUBLE AS power FROM a")
def test_design(spark, sf):
    """The record of the test's design: whom, what, when, and at which error rates."""
    d = {"population": "At Risk", "unit": "customer", "assignment": "stratified by type", "primary_metric": "converted", "guardrail": "mean order value", "baseline_from": BEFORE[0], "baseline_to": BEFORE[1], "test_from": NOW[0], "test_to": NOW[1], "alpha": 0.05, "power": 0.8}
    return _at_risk(spark, sf).agg(F.count("*").alias("available")).select("available", *[F.lit(v).alias(k) for k, v in d.items()])


_AOV = f"{_CONV}, ov AS (SELECT CASE WHEN customer % 2 = 0 THEN 'T' ELSE 'C' END AS arm, revenue::DOUBLE AS v FROM sales JOIN cv USING (customer)), w AS (SELECT avg(v) FILTER (arm = 'T') AS a, avg(v) FILTER (arm = 'C') AS b, var_samp(v) FILTER (arm = 'T') / count(*) FILTER (arm = 'T') AS va, var_samp(v) FILTER (arm = 'C') / count(*) FILTER (arm = 'C') AS vb, count(*) FILTER (arm = 'T') AS na, count(*) FILTER (arm = 'C') AS nb FROM ov)"


@query("guardrail_aov", f"WITH {_AOV} SELECT round(a, 3) AS mean_a, round(b, 3) AS mean_b, round((a - b) / b, 6) AS change, round((a - b) / sqrt(va + vb), 5) AS t, round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 3) AS df, (a - b) / b >= -0.05 AS guardrail FROM w")
def guardrail_aov(spark, sf):
    o = V.sales(spark, sf).join(_outcome(spark, sf).select("customer", "arm"), "customer").withColumn("v", F.col("revenue").cast("double"))
    g = X.welch(o, "arm", "v", "Treatment", "Control")
    return g.select(F.round("mean_a", 3).alias("mean_a"), F.round("mean_b", 3).alias("mean_b"), F.round("change", 6).alias("change"), F.round("t", 5).alias("t"), F.round("df", 3).alias("df"), "guardrail")


_CASES = [(True, 2.0, True, 0.1, 0.01), (True, -0.5, True, 0.1, 0.01), (False, 2.0, True, 0.1, 0.01), (False, 2.0, True, 0.001, 0.01), (True, 2.0, False, 0.1, 0.01)]


@query("experiment_verdicts", "WITH c(s, roi, g, lift, be) AS (VALUES " + ", ".join(str(c).lower() for c in _CASES) + ") SELECT s AS significant, roi::DOUBLE AS roi, lift::DOUBLE AS lift, g AS guardrail, CASE WHEN s AND roi > 0 AND g THEN 'SCALE' WHEN s AND roi <= 0 THEN 'NO_SCALE_ROI' WHEN NOT s AND lift > be THEN 'FOLLOW_UP' ELSE 'NO_GO' END AS verdict FROM c")
def experiment_verdicts(spark, sf):
    c = spark.createDataFrame(_CASES, "significant boolean, roi double, guardrail boolean, lift double, be double")
    return c.select("significant", "roi", "lift", "guardrail", X.verdict(F.col("significant"), F.col("roi"), F.col("guardrail"), F.col("lift"), F.col("be")).alias("verdict"))


@query("simulated_experiment")
def simulated_experiment(spark, sf):
    """Outcomes as they would be at the arms' sizes, the measured base rate and the detectable lift: what the test could show before it runs."""
    n = {r["arm"]: r["count"] for r in _assigned(spark, sf).groupBy("arm").count().collect()}  # two rows
    d = power_analysis(spark, sf).first()
    n1, n2 = n.get("Treatment", 0), n.get("Control", 0)
    x1, x2 = X.simulated_outcomes(n1, n2, d["baseline_rate"], d["detectable_mde"])
    return spark.createDataFrame([(x1, n1, x2, n2)], "x1 int, n1 int, x2 int, n2 int")
