from pyspark.sql import functions as F

from stockyard.operators import control as C
from stockyard.plans.catalog import query
from stockyard.sources import views as V

KPI = """kpi AS (SELECT warehouse, date, count(*) AS volume, avg(CASE WHEN task_type = 'Pick' THEN CAST(1 - error AS DOUBLE) END) AS pick_accuracy, sum(error) AS errors, sum(error) / count(*) AS error_rate, CAST(sum(duration) AS DOUBLE) / count(*) AS mean_duration,
 CAST(sum(duration) FILTER (task_type = 'Pick') AS DOUBLE) / nullif(count(*) FILTER (task_type = 'Pick'), 0) AS mean_pick_duration, count(DISTINCT operator) AS operators FROM tasks GROUP BY warehouse, date)"""
LONG = f"""{KPI}, lm AS (SELECT warehouse, date, 'pick_accuracy' AS metric, pick_accuracy AS x FROM kpi UNION ALL SELECT warehouse, date, 'error_rate', error_rate FROM kpi UNION ALL SELECT warehouse, date, 'mean_duration', mean_duration FROM kpi),
based AS (SELECT *, CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END AS mu, CASE WHEN count(x) OVER w >= 10 THEN stddev_samp(x) OVER w END AS sd, row_number() OVER (PARTITION BY warehouse, metric ORDER BY date) AS i, x - lag(x) OVER (PARTITION BY warehouse, metric ORDER BY date) AS st FROM lm WINDOW w AS (PARTITION BY warehouse, metric ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
RULES = f"""{LONG}, ruled AS (SELECT warehouse, date, metric, coalesce(x > mu + 3*sd OR x < mu - 3*sd, false) AS rule1,
 coalesce(count(mu) OVER w3 = 3 AND count(sd) OVER w3 = 3 AND (count_if(x > mu + 2*sd) OVER w3 >= 2 OR count_if(x < mu - 2*sd) OVER w3 >= 2), false) AS rule2,
 coalesce(i >= 8 AND (count_if(x > mu) OVER w8 = 8 OR (count_if(x > mu) OVER w8 = 0 AND count(mu) OVER w8 = 8)), false) AS rule3,
 coalesce(i >= 6 AND (count_if(st > 0) OVER w5 = 5 OR count_if(st < 0) OVER w5 = 5), false) AS rule4
 FROM based WINDOW w3 AS (PARTITION BY warehouse, metric ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY warehouse, metric ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY warehouse, metric ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def kpis(spark, sf):
    return C.daily_kpis(V.tasks(spark, sf))


def based(spark, sf):
    return C.baseline(C.long_metrics(kpis(spark, sf)))


_K = ("pick_accuracy", "error_rate", "mean_duration", "mean_pick_duration")


@query("daily_kpis", f"WITH {KPI} SELECT warehouse, date, volume, CAST(errors AS BIGINT) AS errors, operators, {', '.join(f'round({c}, 6) AS {c}' for c in _K)} FROM kpi")
def daily_kpis(spark, sf):
    return kpis(spark, sf).select("warehouse", "date", "volume", "errors", "operators", *[F.round(c, 6).alias(c) for c in _K])


@query("operator_kpis", "SELECT operator, warehouse, date, count(*) AS tasks, round(sum(error) / count(*), 6) AS error_rate, round(CAST(sum(duration) AS DOUBLE) / count(*), 6) AS mean_duration FROM tasks GROUP BY ALL HAVING count(*) >= 5")
def operator_kpis(spark, sf):
    return C.operator_kpis(V.tasks(spark, sf)).withColumns({c: F.round(c, 6) for c in ("error_rate", "mean_duration")})


@query("rolling_baseline", f"WITH {LONG} SELECT warehouse, date, metric, round(x, 6) AS x, round(mu, 6) AS mu, round(sd, 6) AS sd FROM based")
def rolling_baseline(spark, sf):
    return based(spark, sf).withColumns({c: F.round(c, 6) for c in ("x", "mu", "sd")})


@query("run_rules", f"WITH {RULES} SELECT warehouse, date, metric, rule1, rule2, rule3, rule4 FROM ruled")
def run_rules(spark, sf):
    return C.run_rules(based(spark, sf)).select("warehouse", "date", "metric", "rule1", "rule2", "rule3", "rule4")


_CUSUM = f"""{LONG}, fill AS (SELECT warehouse, metric, date, x, i, coalesce(mu, avg(x) OVER s) AS mu, coalesce(sd, stddev_samp(x) OVER s) AS sd FROM based WINDOW s AS (PARTITION BY warehouse, metric)),
z AS (SELECT warehouse, metric, date, i, (x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1e-9 END AS z FROM fill),
sums AS (SELECT warehouse, metric, date, i, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS m, false AS alarm FROM z WHERE i = 1
 UNION ALL SELECT z.warehouse, z.metric, z.date, z.i, CASE WHEN np > 4 OR nm > 4 THEN 0 ELSE np END, CASE WHEN np > 4 OR nm > 4 THEN 0 ELSE nm END, np > 4 OR nm > 4
 FROM (SELECT z.*, CASE WHEN z.z IS NULL THEN s.p ELSE greatest(0, s.p + z.z - 0.5::DOUBLE) END AS np, CASE WHEN z.z IS NULL THEN s.m ELSE greatest(0, s.m - z.z - 0.5::DOUBLE) END AS nm FROM sums s JOIN z ON z.warehouse = s.warehouse AND z.metric = s.metric AND z.i = s.i + 1) z)"""


def _recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("cusum", f"WITH RECURSIVE {_CUSUM} SELECT warehouse, metric, date, round(p, 6) AS c_plus, round(m, 6) AS c_minus, alarm FROM sums")
def cusum(spark, sf):
    return C.cusum(based(spark, sf)).withColumns({c: F.round(c, 6) for c in ("c_plus", "c_minus")})


@query("spc_anomalies", f"WITH RECURSIVE {RULES}, {_CUSUM[len(LONG) + 2:]} SELECT warehouse, date, metric, 'rule1' AS rule FROM ruled WHERE rule1 UNION SELECT warehouse, date, metric, 'rule2' FROM ruled WHERE rule2 UNION SELECT warehouse, date, metric, 'rule3' FROM ruled WHERE rule3 UNION SELECT warehouse, date, metric, 'rule4' FROM ruled WHERE rule4 UNION SELECT warehouse, date, metric, 'cusum' FROM sums WHERE alarm")
def spc_anomalies(spark, sf):
    b = based(spark, sf)
    return C.anomalies(C.run_rules(b), C.cusum(b))


@query("sigma_sensitivity", f"WITH {LONG}, d AS (SELECT warehouse, date, max(abs(x - mu) / nullif(sd, 0)) AS z FROM based WHERE sd IS NOT NULL GROUP BY ALL) SELECT warehouse, s.sigma, count_if(z > s.sigma) AS days FROM d, (VALUES (2.0::DOUBLE), (2.5::DOUBLE), (3.0::DOUBLE)) s(sigma) GROUP BY ALL", long="days")
def sigma_sensitivity(spark, sf):
    return C.sigma_sensitivity(based(spark, sf))
