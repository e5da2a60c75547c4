from pyspark.sql import functions as F

from stockyard.operators import arima as A
from stockyard.operators import forecast as O
from stockyard.operators import panel as P
from stockyard.plans.catalog import f_upper, normal_cdf, query, t_two_sided
from stockyard.sources import views as V


def _parts(spark, sf, key="category"):
    return O.split(V.dense(spark, sf, key))


PARTS = "pt AS (SELECT k, date, q, date_diff('day', min(date) OVER (), date) AS t, date_diff('day', min(date) OVER (), max(date) OVER ()) + 1 AS n, date_diff('day', date, max(date) OVER ()) >= 92 AS train FROM dense)"
BPARTS = PARTS.replace("dense", "brand_dense")
NAIVE = "nv AS (SELECT k, date, q, 'Naive' AS model, f AS forecast FROM pt JOIN (SELECT k, max_by(q, date) AS f FROM pt WHERE train GROUP BY k) USING (k) WHERE NOT train)"
SNAIVE = "sn AS (SELECT a.k, a.date, a.q, 'SeasonalNaive' AS model, b.q AS forecast FROM pt a JOIN pt b ON a.k = b.k AND b.t = a.n - 92 - 7 + (a.t - (a.n - 92)) % 7 WHERE NOT a.train)"
# Croston as the fold that defines it, so the closed form is checked against another way.
CROSTON = """cd AS (SELECT k, t, q, row_number() OVER w AS i, t - lag(t) OVER w AS gap FROM pt WHERE train AND q > 0 WINDOW w AS (PARTITION BY k ORDER BY t)),
cf AS (SELECT k, i, q::DOUBLE AS a, 1::DOUBLE AS p FROM cd WHERE i = 1 UNION ALL SELECT cd.k, cd.i, a + 0.1::DOUBLE * (cd.q - a), p + 0.1::DOUBLE * (gap - p) FROM cf JOIN cd ON cd.k = cf.k AND cd.i = cf.i + 1),
cr AS (SELECT k, arg_max(a, i) AS size, arg_max(p, i) AS interval_ FROM cf GROUP BY k)"""
ACC = "acc AS (SELECT k, model, avg(CASE WHEN q > 0 THEN abs(forecast - q) / q * 100 END) AS mape, sqrt(avg((forecast - q) * (forecast - q))) AS rmse, avg(abs(forecast - q)) AS mae, avg(forecast - q) AS bias FROM fc GROUP BY k, model)"
_M = ("mape", "rmse", "mae", "bias")
_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in _M)


def _r(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("dense_panel", "SELECT k, date, q FROM dense")
def dense_panel(spark, sf):
    return V.dense(spark, sf)


@query("active_series", f"WITH {BPARTS}, g AS (SELECT k, count_if(q > 0) / count(*) AS share, count_if(train AND q > 0) / count_if(train) AS ts FROM pt GROUP BY k) SELECT k, round(share, 6) AS share, round(ts, 6) AS train_share, share > 0.10 AND ts >= 0.30 AS active FROM g")
def active_series(spark, sf):
    return _r(O.activity(_parts(spark, sf, "brand")), ("share", "train_share"))


@query("demand_patterns", f"WITH {BPARTS} SELECT k, CASE WHEN count_if(train AND q = 0) / count_if(train) > 0.4 THEN 'intermittent' ELSE 'regular' END AS pattern, CASE WHEN 1 - count_if(train AND q > 0) / count(*) >= 0.4 THEN 'intermittent' ELSE 'regular' END AS pattern_all_days FROM pt GROUP BY k")
def demand_patterns(spark, sf):
    return O.patterns(_parts(spark, sf, "brand"))


def baselines(spark, sf):
    p = _parts(spark, sf)
    return O.naive(p).unionByName(O.seasonal_naive(p))


@query("naive_forecasts", f"WITH {PARTS}, {NAIVE}, {SNAIVE} SELECT * FROM nv UNION ALL SELECT * FROM sn")
def naive_forecasts(spark, sf):
    return baselines(spark, sf)


@query("baseline_accuracy", f"WITH {PARTS}, {NAIVE}, {SNAIVE}, fc AS (SELECT * FROM nv UNION ALL SELECT * FROM sn), {ACC} SELECT k, model, {_ROUND} FROM acc")
def baseline_accuracy(spark, sf):
    return _r(O.accuracy(baselines(spark, sf)), _M)


@query("croston", f"WITH RECURSIVE {BPARTS}, {CROSTON} SELECT k, round(size, 6) AS size, round(interval_, 6) AS interval, round(size / interval_, 6) AS croston, round(size / interval_ * 0.95::DOUBLE, 6) AS sba FROM cr")
def croston(spark, sf):
    return _r(O.croston(_parts(spark, sf, "brand")), ("size", "interval", "croston", "sba"))


@query("croston_accuracy", f"WITH RECURSIVE {BPARTS}, {CROSTON}, fc AS (SELECT k, date, q, 'Croston' AS model, size / interval_ AS forecast FROM pt JOIN cr USING (k) WHERE NOT train UNION ALL SELECT k, date, q, 'SBA', size / interval_ * 0.95::DOUBLE FROM pt JOIN cr USING (k) WHERE NOT train), {ACC} SELECT k, model, {_ROUND} FROM acc")
def croston_accuracy(spark, sf):
    return _r(O.accuracy(O.croston_forecasts(_parts(spark, sf, "brand"))), _M)


_SES = f"""{PARTS}, s0 AS (SELECT k, avg(q) AS l0 FROM pt WHERE train AND t < 10 GROUP BY k), gr AS (SELECT (i + 1) / 20 AS alpha FROM range(19) r(i)),
sf AS (SELECT k, alpha, 0::BIGINT AS t, l0 + alpha * (q - l0) AS l, (q - l0) * (q - l0) AS e FROM s0 JOIN pt USING (k), gr WHERE t = 0 UNION ALL SELECT sf.k, alpha, sf.t + 1, l + alpha * (q - l), e + (q - l) * (q - l) FROM sf JOIN pt ON pt.k = sf.k AND pt.t = sf.t + 1 WHERE train),
fin AS (SELECT * FROM sf QUALIFY row_number() OVER (PARTITION BY k, alpha ORDER BY t DESC) = 1), ses AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY k ORDER BY e, alpha) = 1)"""


@query("ses_levels", f"WITH RECURSIVE {_SES} SELECT k, round(alpha, 4) AS alpha, round(l, 6) AS level FROM ses")
def ses_levels(spark, sf):
    return O.ses(_parts(spark, sf)).select("k", F.round("alpha", 4).alias("alpha"), F.round("level", 6).alias("level"))


@query("ses_likelihood")
def ses_likelihood(spark, sf):
    """Level and start by likelihood, and the forecast's accuracy on the test days beside that of the grid's fit."""
    p = _parts(spark, sf)
    f = p.filter("not train").join(O.ses_likelihood(p), "k").select("k", "date", "q", F.lit("SES").alias("model"), F.col("level").alias("forecast"))
    grid = O.accuracy(O.ses_forecasts(p)).select("k", F.col("rmse").alias("rmse_of_grid"))
    return O.ses_likelihood(p).join(O.accuracy(f).drop("model"), "k", "left").join(grid, "k", "left")


_ALL = f"{_SES}, {NAIVE}, {SNAIVE}, fc AS (SELECT * FROM nv UNION ALL SELECT * FROM sn UNION ALL SELECT pt.k, date, q, 'SES', l FROM pt JOIN ses USING (k) WHERE NOT train), {ACC}, cls AS (SELECT DISTINCT k, CASE WHEN k < 'N' THEN 'A' ELSE 'B' END AS class, CASE WHEN length(k) % 2 = 0 THEN 'regular' ELSE 'intermittent' END AS pattern FROM series)"


def _scored(spark, sf):
    return O.accuracy(baselines(spark, sf).unionByName(O.ses_forecasts(_parts(spark, sf))))


def _classes(spark, sf):
    part = V.read_table(spark, sf, "part").select(F.col("p_type").alias("k")).distinct()
    return part.select("k", F.when(F.col("k") < "N", "A").otherwise("B").alias("class"), F.when(F.length("k") % 2 == 0, "regular").otherwise("intermittent").alias("pattern"))


_COMPARE = f"{_ALL}, cmp AS (SELECT model, class, pattern, count(DISTINCT k) AS n, avg(mape) AS mean_mape, avg(rmse) AS mean_rmse FROM acc JOIN cls USING (k) GROUP BY model, class, pattern UNION ALL SELECT model, class, 'all', count(DISTINCT k), avg(mape), avg(rmse) FROM acc JOIN cls USING (k) GROUP BY model, class)"


@query("model_comparison", f"WITH RECURSIVE {_COMPARE} SELECT model, class, pattern, n, round(mean_mape, 6) AS mean_mape, round(mean_rmse, 6) AS mean_rmse FROM cmp")
def model_comparison(spark, sf):
    return _r(O.comparison(_scored(spark, sf), _classes(spark, sf)), ("mean_mape", "mean_rmse"))


@query("best_model_per_class", f"WITH RECURSIVE {_COMPARE} SELECT class, pattern, model, n, round(mean_mape, 6) AS mean_mape FROM cmp QUALIFY row_number() OVER (PARTITION BY class, pattern ORDER BY cmp.mean_mape, model) = 1")
def best_model_per_class(spark, sf):
    return O.best_model(O.comparison(_scored(spark, sf), _classes(spark, sf)), ["class", "pattern"]).select("class", "pattern", "model", "n", F.round("mean_mape", 6).alias("mean_mape"))


@query("two_level_mape", f"WITH RECURSIVE {_COMPARE}, per AS (SELECT model, avg(mape) AS per_series FROM acc GROUP BY model) SELECT model, round(avg(mean_mape), 6) AS mean_of_class_means, round(any_value(per_series), 6) AS mean_of_series FROM cmp JOIN per USING (model) WHERE pattern = 'all' GROUP BY model")
def two_level_mape(spark, sf):
    """The mean of class means beside the mean over series: they differ, and both are called overall."""
    s = _scored(spark, sf)
    c = O.comparison(s, _classes(spark, sf)).filter("pattern = 'all'").groupBy("model").agg(F.round(F.avg("mean_mape"), 6).alias("mean_of_class_means"))
    return c.join(s.groupBy("model").agg(F.round(F.avg("mape"), 6).alias("mean_of_series")), "model")


_DIFF = f"{_ALL}, df AS (SELECT a.mape - b.mape AS d FROM acc a JOIN acc b ON a.k = b.k AND a.model = 'SES' AND b.model = 'Naive')"


@query("paired_t_test", f"WITH RECURSIVE {_DIFF} SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM df")
def paired_t_test(spark, sf):
    return _r(O.paired_t(_scored(spark, sf), "SES", "Naive"), ("mean_diff", "t")).drop("p")


@query("wilcoxon_test", f"WITH RECURSIVE {_DIFF}, rr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM df WHERE d <> 0) SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM rr")
def wilcoxon_test(spark, sf):
    return O.wilcoxon(_scored(spark, sf), "SES", "Naive").select("n", "w")


_RANKED = "w_ranks AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM df WHERE d <> 0), w_sums AS (SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, sum(c * c - 1) AS tt FROM w_ranks), w_z AS (SELECT (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tt / 48) AS z FROM w_sums)"


@query("model_tests_p", f"WITH RECURSIVE {_DIFF}, {_RANKED}, t_one AS (SELECT count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM df) SELECT 'paired t' AS test, round({t_two_sided('t', 'n - 1')}, 6) AS p FROM t_one UNION ALL SELECT 'wilcoxon', round(2 - 2 * {normal_cdf('abs(z)')}, 6) FROM w_z")
def model_tests_p(spark, sf):
    s = _scored(spark, sf)
    return _r(O.paired_t(s, "SES", "Naive").select(F.lit("paired t").alias("test"), "p").unionByName(O.wilcoxon(s, "SES", "Naive").select(F.lit("wilcoxon").alias("test"), "p")), ("p",))


_WEEKDAY = "WITH d AS (SELECT k, isodow(date) AS w, q FROM dense), m AS (SELECT k, w, count(*) AS c, avg(q) AS mu FROM d GROUP BY k, w), a AS (SELECT k, avg(q) AS mu, count(*) AS n FROM d GROUP BY k), b AS (SELECT k, sum(c * (m.mu - a.mu) ** 2) / 6 AS msb FROM m JOIN a USING (k) GROUP BY k), s AS (SELECT d.k, sum((q - mu) ** 2) / (any_value(n.n) - 7) AS msw FROM d JOIN m USING (k, w) JOIN (SELECT k AS k, count(*) AS n FROM d GROUP BY k) n ON n.k = d.k GROUP BY d.k)"


@query("weekday_f_test", f"{_WEEKDAY} SELECT k, round(msb / msw, 5) AS f FROM b JOIN s USING (k)")
def weekday_f_test(spark, sf):
    return O.weekday_f(V.dense(spark, sf)).select("k", F.round("f", 5).alias("f"))


@query("weekday_f_test_p", f"{_WEEKDAY}, y AS (SELECT k, msb / msw AS f, (SELECT count(*) FROM d WHERE d.k = b.k) - 7 AS dd FROM b JOIN s USING (k)) SELECT k, round(f, 5) AS f, round({f_upper('f', '6', 'dd')}, 6) AS p FROM y")
def weekday_f_test_p(spark, sf):
    return O.weekday_f(V.dense(spark, sf)).select("k", F.round("f", 5).alias("f"), F.round("p", 6).alias("p"))


_ACF = "x AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY date) AS i, q - avg(q) OVER (PARTITION BY k) AS x FROM dense), l AS (SELECT range AS lag FROM range(26)), c AS (SELECT a.k, lag, sum(a.x * b.x) AS c FROM x a, l JOIN x b ON b.k = a.k AND b.i = a.i - lag GROUP BY a.k, lag), r AS (SELECT k, lag, c / max(c) FILTER (lag = 0) OVER (PARTITION BY k) AS acf FROM c), nn AS (SELECT k, count(*) AS n FROM dense GROUP BY k)"


@query("acf", f"WITH {_ACF} SELECT k, CAST(lag AS INT) AS lag, round(acf, 6) AS acf FROM r")
def acf(spark, sf):
    return O.acf(V.dense(spark, sf)).select("k", "lag", F.round("acf", 6).alias("acf"))


_PACF = "rs AS (SELECT k, list(acf ORDER BY lag) AS r FROM r GROUP BY k), pc AS (SELECT k, r, 1 AS m, [r[2]] AS phi FROM rs UNION ALL SELECT k, r, m + 1, list_concat([phi[j] - l * phi[m + 1 - j] for j in range(1, m + 1)], [l]) FROM (SELECT *, (r[m + 2] - list_sum([phi[j] * r[m + 2 - j] for j in range(1, m + 1)])) / (1 - list_sum([phi[j] * r[j + 1] for j in range(1, m + 1)])) AS l FROM pc WHERE m < 25))"


@query("pacf", f"WITH RECURSIVE {_ACF}, {_PACF} SELECT k, CAST(m AS INT) AS lag, round(phi[m], 6) AS pacf FROM pc UNION ALL SELECT k, CAST(0 AS INT), 1.0::DOUBLE FROM rs")
def pacf(spark, sf):
    return _r(O.pacf(O.acf(V.dense(spark, sf))), ("pacf",))


@query("ljung_box", f"WITH {_ACF} SELECT k, round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)), 4) AS q FROM r JOIN nn USING (k) WHERE lag BETWEEN 1 AND 10 GROUP BY k")
def ljung_box(spark, sf):
    return O.ljung_box(O.acf(V.dense(spark, sf), 10)).select("k", F.round("q", 4).alias("q"))


@query("decomposition", """WITH c AS (SELECT k, date, q, row_number() OVER (PARTITION BY k ORDER BY date) AS i, count(*) OVER (PARTITION BY k) AS n, CASE WHEN count(*) OVER w = 7 THEN avg(q) OVER w END AS trend FROM dense WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
e AS (SELECT k, regr_slope(trend, i) FILTER (i <= 10) AS fs, regr_intercept(trend, i) FILTER (i <= 10) AS fi, regr_slope(trend, i) FILTER (i > n - 10) AS bs, regr_intercept(trend, i) FILTER (i > n - 10) AS bi FROM c WHERE trend IS NOT NULL GROUP BY k),
t AS (SELECT k, date, q, CASE WHEN i <= 3 THEN fi + fs * i WHEN i > n - 3 THEN bi + bs * i ELSE trend END AS trend FROM c JOIN e USING (k)),
d AS (SELECT k, isodow(date) AS w, avg(q - trend) AS s FROM t GROUP BY ALL), m AS (SELECT k, w, s - avg(s) OVER (PARTITION BY k) AS s FROM d)
SELECT t.k, date, q, round(trend, 6) AS trend, round(s, 6) AS seasonal, round(q - trend - s, 6) AS residual FROM t JOIN m ON m.k = t.k AND m.w = isodow(date)""")
def decomposition(spark, sf):
    return _r(O.decompose(V.dense(spark, sf)), ("trend", "seasonal", "residual"))


@query("adf_test")
def adf_test(spark, sf):
    return O.adf_by_key(_parts(spark, sf))


@query("arima_forecasts")
def arima_forecasts(spark, sf):
    return A.forecasts(_parts(spark, sf))


@query("sarima_forecasts")
def sarima_forecasts(spark, sf):
    return A.forecasts(_parts(spark, sf), ("SARIMA",))


@query("arima_variants")
def arima_variants(spark, sf):
    """Both variants of each series with their orders, AIC, whiteness of the innovations and accuracy; `best` marks the lower mape (a tie: ARIMA)."""
    f = A.forecasts(_parts(spark, sf), ("ARIMA", "SARIMA"))
    # One aggregate over the fits: a second use of f would fit again.
    e, order = F.col("forecast") - F.col("q"), F.struct("p_order", "d_order", "q_order")
    s = f.groupBy("k", "model").agg(F.first(order).alias("o"), F.first("aic").alias("aic"), F.first("ljung_box_p").alias("ljung_box_p"), F.avg(F.when(F.col("q") > 0, F.abs(e) / F.col("q") * 100)).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.col("q").between(F.col("low"), F.col("high"))).cast("int")).alias("inside_95"))
    first = F.row_number().over(P.Window.partitionBy("k").orderBy(F.col("mape").asc_nulls_last(), "model")) == 1
    return s.select("k", "model", "o.*", "aic", "ljung_box_p", "mape", "rmse", "mae", "inside_95", first.alias("best"))


@query("qq_points")
def qq_points(spark, sf):
    return O.qq_points(O.decompose(V.dense(spark, sf)))


# Panel features

_LAGS = ", ".join(f"lag(q, {n}) OVER w AS lag_{n}" for n in (1, 7, 14, 28))
_MEANS = ", ".join(f"round(avg(q) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS mean_{n}" for n in (7, 14, 28))


def panel_features(spark, sf):
    d = V.dense(spark, sf).withColumn("_i", F.row_number().over(P.Window.partitionBy("k").orderBy("date")))
    f = d.withColumns({**P.lags("q", "k", "date", (1, 7, 14, 28)), **P.trailing_means("q", "k", "date", (7, 14, 28)), "std_7": P.trailing_std("q", "k", "date"), "weekday": F.weekday("date"), "month": F.month("date"), "quarter": F.quarter("date"), "weekend": (F.weekday("date") >= 5).cast("int"), "since_big": P.days_since(F.col("q") > 150, "k", "date").cast("bigint")})
    codes = P.label_codes(d, "k", "k_code")
    return f.join(codes, "k").dropna(subset=["lag_28"]).drop("_i")


@query("panel_features", f"WITH f AS (SELECT k, date, q, {_LAGS}, {_MEANS}, round(coalesce(stddev_samp(q) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0), 6) AS std_7, CAST(isodow(date) - 1 AS INT) AS weekday, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS weekend, row_number() OVER w AS i FROM dense WINDOW w AS (PARTITION BY k ORDER BY date)), g AS (SELECT *, coalesce(i - max(CASE WHEN q > 150 THEN i END) OVER (PARTITION BY k ORDER BY date), 999) AS since_big, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INT) AS k_code FROM f) SELECT * EXCLUDE (i) FROM g WHERE lag_28 IS NOT NULL")
def panel_features_query(spark, sf):
    return _r(panel_features(spark, sf), ("mean_7", "mean_14", "mean_28", "std_7"))
