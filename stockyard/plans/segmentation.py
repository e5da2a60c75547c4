from pyspark.sql import functions as F

from stockyard.operators import panel as P
from stockyard.operators import segment as S
from stockyard.plans.catalog import query
from stockyard.sources import views as V

# Independent of the operator: the oracle fills the panel sku x day and uses the library's own slope and variance.
_FEATURES = """daily AS (SELECT sku, date, sum(qty) AS q, sum(revenue) AS rev FROM demand GROUP BY ALL),
full_panel AS (SELECT sku, date, coalesce(q, 0) AS q, coalesce(rev, 0) AS rev FROM (SELECT DISTINCT sku FROM demand) CROSS JOIN spine LEFT JOIN daily USING (sku, date)),
mm AS (SELECT *, avg(q) OVER (PARTITION BY sku, month(date)) AS mq FROM full_panel),
agg AS (SELECT sku, count(*) AS n, avg(q) AS mean_demand, stddev_samp(q) AS std_demand, CAST(sum(rev) AS DOUBLE) AS total_revenue, count_if(q > 0) AS nz, sum(q) AS s,
  regr_slope(q, date_diff('day', (SELECT min(date) FROM spine), date)) AS trend, var_samp(mq) / nullif(var_samp(q), 0) AS seas FROM mm GROUP BY sku),
feat AS (SELECT sku, mean_demand, std_demand, CASE WHEN mean_demand > 0 THEN std_demand / mean_demand ELSE 0 END AS cv, total_revenue,
  (rank() OVER (ORDER BY total_revenue) + (count(*) OVER (PARTITION BY total_revenue) - 1) / 2.0) / count(*) OVER () AS revenue_rank,
  nz / n AS frequency, CASE WHEN nz > 0 THEN s / nz ELSE 0 END AS mean_nonzero, CASE WHEN n >= 10 THEN trend ELSE 0 END AS trend, CASE WHEN n >= 24 THEN least(1, greatest(0, coalesce(seas, 0))) ELSE 0 END AS seasonality FROM agg)"""
_SIMPLE = """tot AS (SELECT sku, CAST(sum(revenue) AS DOUBLE) AS total_revenue, avg(stockout) AS stockout_rate FROM demand GROUP BY sku)"""
_CLASSES = """cum AS (SELECT *, sum(total_revenue) OVER (ORDER BY total_revenue DESC, sku ROWS UNBOUNDED PRECEDING) / sum(total_revenue) OVER () AS cum_share FROM feat),
cls AS (SELECT *, CASE WHEN cum_share <= CAST(0.70 AS DOUBLE) THEN 'A' WHEN cum_share <= CAST(0.90 AS DOUBLE) THEN 'B' ELSE 'C' END AS abc, CASE WHEN cv < 0.5 THEN 'X' WHEN cv < 1 THEN 'Y' ELSE 'Z' END AS xyz FROM cum)"""


def features(spark, sf):
    return S.sku_features(V.facts(spark, sf))


def classes(spark, sf):
    return S.classified(features(spark, sf))


def _rounded(df, columns, n=6):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query("sku_features", f"WITH {_FEATURES} SELECT sku, {', '.join(f'round({c}, 6) AS {c}' for c in S.FEATURES)} FROM feat")
def sku_features(spark, sf):
    return _rounded(features(spark, sf), S.FEATURES).select("sku", *S.FEATURES)


_Z = ("mean_demand", "cv", "frequency", "trend")


@query("sku_zscores", f"WITH {_FEATURES} SELECT sku, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}_z' for c in _Z)} FROM feat")
def sku_zscores(spark, sf):
    z = S.z_scores(features(spark, sf).select("sku", *_Z), _Z)
    return z.select("sku", *[F.round(f"{c}_z", 5).alias(f"{c}_z") for c in _Z])


@query("abc_xyz_classes", f"WITH {_FEATURES}, {_CLASSES} SELECT sku, round(cum_share, 6) AS cum_share, abc, xyz, abc || xyz AS abc_xyz FROM cls")
def abc_xyz_classes(spark, sf):
    return classes(spark, sf).select("sku", F.round("cum_share", 6).alias("cum_share"), "abc", "xyz", "abc_xyz")


@query("abc_category_crosstab", f"WITH {_FEATURES}, {_CLASSES}, c AS (SELECT category, count_if(abc = 'A') AS \"A\", count_if(abc = 'B') AS \"B\", count_if(abc = 'C') AS \"C\" FROM cls JOIN (SELECT DISTINCT sku, category FROM demand) USING (sku) GROUP BY category) SELECT * FROM c", long="A B C")
def abc_category_crosstab(spark, sf):
    return S.crosstab(_with_category(spark, sf), "category", "abc", ["A", "B", "C"])


@query("abc_category_shares", f"WITH {_FEATURES}, {_CLASSES}, c AS (SELECT category, round(count_if(abc = 'A') / count(*), 6) AS \"A\", round(count_if(abc = 'B') / count(*), 6) AS \"B\", round(count_if(abc = 'C') / count(*), 6) AS \"C\" FROM cls JOIN (SELECT DISTINCT sku, category FROM demand) USING (sku) GROUP BY category) SELECT * FROM c")
def abc_category_shares(spark, sf):
    return _rounded(S.crosstab(_with_category(spark, sf), "category", "abc", ["A", "B", "C"], share=True), "ABC")


def _with_category(spark, sf):
    part = V.read_table(spark, sf, "part").select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("category"))
    return classes(spark, sf).join(part, "sku")


_ARI = """cell AS (SELECT u, v, count(*) AS c FROM lab GROUP BY u, v), ru AS (SELECT u, sum(c) AS a FROM cell GROUP BY u), rv AS (SELECT v, sum(c) AS b FROM cell GROUP BY v), nn AS (SELECT sum(c) AS n FROM cell),
p AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM cell) AS same, (SELECT sum(a * (a - 1) / 2) FROM ru) AS su, (SELECT sum(b * (b - 1) / 2) FROM rv) AS sv, n,
 (SELECT sum(c / n * ln(c * n / (a * b))) FROM cell JOIN ru USING (u) JOIN rv USING (v)) AS mi, (SELECT -sum(a / n * ln(a / n)) FROM ru) AS hu, (SELECT -sum(b / n * ln(b / n)) FROM rv) AS hv FROM nn)
SELECT CAST(n AS BIGINT) AS n, round((same - su * sv / (n * (n - 1) / 2)) / ((su + sv) / 2 - su * sv / (n * (n - 1) / 2)), 6) AS ari, round(2 * mi / (hu + hv), 6) AS nmi FROM p"""


@query("agreement_abc_xyz", f"WITH {_FEATURES}, {_CLASSES}, lab AS (SELECT abc AS u, xyz || CAST(ntile AS VARCHAR) AS v FROM (SELECT *, sku % 4 AS ntile FROM cls)), {_ARI}")
def agreement_abc_xyz(spark, sf):
    df = classes(spark, sf).withColumn("v", F.concat("xyz", (F.col("sku") % 4).cast("string")))
    return _rounded(S.agreement(df, "abc", "v"), ("ari", "nmi"))


@query("embedding_label_agreement", f"WITH lab AS (SELECT label AS u, CASE WHEN embedding[1] > 0 THEN label % 5 ELSE label END AS v FROM embeddings), {_ARI}")
def embedding_label_agreement(spark, sf):
    e = V.read_table(spark, sf, "embeddings").select(F.col("label").alias("u"), F.when(F.col("embedding")[0] > 0, F.col("label") % 5).otherwise(F.col("label")).alias("v"))
    return _rounded(S.agreement(e, "u", "v"), ("ari", "nmi"))


@query(
    "group_separation",
    f"""WITH {_FEATURES}, {_CLASSES}, {_SIMPLE}, t AS (SELECT abc, xyz, abc || xyz AS abc_xyz, mean_demand, stockout_rate FROM cls JOIN tot USING (sku)),
long AS (SELECT 'abc' AS grouping, abc AS label, * FROM t UNION ALL SELECT 'xyz', xyz, * FROM t UNION ALL SELECT 'abc_xyz', abc_xyz, * FROM t),
per AS (SELECT grouping, label, avg(stockout_rate) AS r, avg(mean_demand) AS v, CASE WHEN avg(mean_demand) > 0 THEN stddev_samp(mean_demand) / avg(mean_demand) ELSE 0 END AS cv FROM long GROUP BY ALL)
SELECT grouping, count(*) AS n_groups, round(max(r) - min(r), 6) AS rate_range, round(max(v) / min(v), 6) AS value_ratio, round(avg(cv), 6) AS mean_cv FROM per GROUP BY grouping""",
)
def group_separation(spark, sf):
    rate = V.facts(spark, sf).groupBy("sku").agg(F.avg("stockout").alias("stockout_rate"))
    return _rounded(S.separation(classes(spark, sf).join(rate, "sku"), ["abc", "xyz", "abc_xyz"], "stockout_rate", "mean_demand"), ("rate_range", "value_ratio", "mean_cv"))


@query("class_disagreements", f"WITH {_FEATURES}, {_CLASSES}, r AS (SELECT sku, abc, frequency, ntile, total_revenue FROM (SELECT *, CAST((4 * row_number() OVER (ORDER BY mean_nonzero, sku) + count(*) OVER () - 1) // count(*) OVER () AS INT) AS ntile FROM cls)) SELECT sku, abc, ntile AS demand_quartile, round(total_revenue, 4) AS total_revenue FROM r WHERE abc = 'A' AND ntile = 1 OR abc = 'C' AND ntile = 4 ORDER BY total_revenue DESC, sku LIMIT 10")
def class_disagreements(spark, sf):
    df = classes(spark, sf).withColumn("demand_quartile", P.first_rank_quintile(F.col("mean_nonzero"), "sku", 4))
    odd = df.filter(((F.col("abc") == "A") & (F.col("demand_quartile") == 1)) | ((F.col("abc") == "C") & (F.col("demand_quartile") == 4)))
    return odd.orderBy(F.desc("total_revenue"), "sku").limit(10).select("sku", "abc", "demand_quartile", F.round("total_revenue", 4).alias("total_revenue"))


@query("category_mode", "WITH n AS (SELECT brand, category, count(*) AS n FROM demand GROUP BY ALL) SELECT brand, category AS mode_category FROM n QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, category) = 1")
def category_mode(spark, sf):
    return V.demand(spark, sf).groupBy("brand").agg(S.modal("category").alias("mode_category"))
