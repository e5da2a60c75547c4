from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.operators import cluster as K
from stockyard.operators import multistart as M
from stockyard.operators import segment as S
from stockyard.operators.running import running
from stockyard.plans.catalog import query
from stockyard.plans.segmentation import _CLASSES, _FEATURES, classes, features
from stockyard.sources import views as V

FEATURES = [f"{c}_z" for c in S.FEATURES]
NAMES = ["Low-Velocity / Low-Value", "Low-Velocity / High-Value", "High-Velocity / Low-Value", "High-Velocity / High-Value"]
_E = [f"e{i}" for i in range(64)]


def _z(spark, sf):
    return S.z_scores(features(spark, sf), S.FEATURES).select("sku", *FEATURES)


def _clusters(spark, sf, k=4, starts=50):
    """(sku, cluster): the best of 50 starts of up to 1,000 steps."""
    return M.fit_all(_z(spark, sf), "sku", FEATURES, [M.Fit("k", k, starts)], 1000)[0].drop("fit")


def _embedded(spark, sf):
    e = V.read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_E)])


_EMB = "e AS (SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(_E)) + " FROM embeddings)"
_D = lambda a, b: "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) ** 2" for c in _E) + ")"


@query(
    "cluster_quality",
    f"""WITH {_EMB}, g AS (SELECT label, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in _E)} FROM e GROUP BY label), t AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in _E)} FROM e),
w AS (SELECT e.label, sum({_D('e', 'g')} ** 2) AS w, avg({_D('e', 'g')}) AS s FROM e JOIN g USING (label) GROUP BY e.label), b AS (SELECT sum(n * {_D('g', 't')} ** 2) AS b, count(*) AS k, sum(n) AS n FROM g, t),
r AS (SELECT g.label, max((wa.s + wb.s) / {_D('g', 'h')}) AS r FROM g JOIN g h ON g.label <> h.label JOIN w wa ON wa.label = g.label JOIN w wb ON wb.label = h.label GROUP BY g.label)
SELECT k, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / ((SELECT sum(w) FROM w) / (n - k)), 5) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin FROM b""",
)
def cluster_quality(spark, sf):
    q = K.quality(_embedded(spark, sf), _E, "label")
    return q.select("k", "n", F.round("calinski_harabasz", 5).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("silhouettes", f"WITH {_EMB}, m AS (SELECT a.id, a.label AS la, b.label AS lb, avg({_D('a', 'b')}) AS d FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL), s AS (SELECT id, la, max(d) FILTER (la = lb) AS own, min(d) FILTER (la <> lb) AS other FROM m GROUP BY ALL) SELECT id, la AS label, round(coalesce((other - own) / greatest(own, other), 0), 6) AS silhouette FROM s")
def silhouettes(spark, sf):
    return K.silhouette(_embedded(spark, sf), "id", _E, "label", None).withColumn("silhouette", F.round("silhouette", 6))


_TIERS = range(2, 13)


@query(
    "choose_k",
    f"""WITH {_FEATURES}, f AS (SELECT sku, round(mean_demand, 6) AS x, row_number() OVER (ORDER BY round(mean_demand, 6), sku) AS rn, count(*) OVER () AS m FROM feat),
t AS (SELECT k, rn, x, (k * rn + m - 1) // m AS tier, m FROM f, range(2, 13) r(k)), g AS (SELECT k, tier, avg(x) AS c, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT t.k, t.rn, any_value(t.m) AS m, min(abs(t.x - g.c)) FILTER (g.tier = t.tier) AS own, min(abs(t.x - g.c)) FILTER (g.tier <> t.tier) AS other FROM t JOIN g USING (k) GROUP BY t.k, t.rn),
s AS (SELECT k, sum(own * own) AS inertia, round(avg(CASE WHEN greatest(own, other) > 0 THEN (other - own) / greatest(own, other) ELSE 0 END), 9) AS silhouette, any_value(m) AS m FROM p GROUP BY k),
b AS (SELECT g.k, sum(n * (c - a.x) ** 2) AS b FROM g, (SELECT avg(x) AS x FROM f) a GROUP BY g.k),
w AS (SELECT k, inertia, silhouette, (b / (k - 1)) / (inertia / (m - k)) AS ch FROM s JOIN b USING (k)),
d AS (SELECT *, lag(silhouette) OVER v AS p, lead(silhouette) OVER v AS n, -(lead(inertia) OVER o - 2 * inertia + lag(inertia) OVER o) AS bend FROM w WINDOW v AS (PARTITION BY k >= 3 ORDER BY k), o AS (ORDER BY k))
SELECT coalesce((SELECT k FROM d WHERE k >= 3 AND silhouette > p AND silhouette > n ORDER BY ch DESC, k LIMIT 1), (SELECT k FROM d WHERE k >= 3 ORDER BY silhouette DESC, k LIMIT 1))::INT AS k_chosen, (SELECT k FROM d WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1)::INT AS k_elbow""",
)
def choose_k(spark, sf):
    """The rule on a sweep that SQL can follow: k tiers of equal size by mean demand, their silhouettes to centres."""
    f = features(spark, sf).select("sku", F.round("mean_demand", 6).alias("x"))
    ranked = running(f, [F.col("x"), F.col("sku")], number="rn").join(F.broadcast(f.agg(F.count("*").alias("m"))))  # one row
    t = ranked.select("x", "m", "rn", F.explode(F.array(*map(F.lit, _TIERS))).alias("k")).withColumn("tier", F.expr("(k * rn + m - 1) div m"))
    g = t.groupBy("k", "tier").agg(F.avg("x").alias("c"), F.count("*").alias("n"))
    centres = g.groupBy("k").agg(F.collect_list(F.struct("tier", "c")).alias("cs"))  # 2 .. 12 centres a row, 11 rows
    gap = lambda c: F.abs(F.col("x") - c["c"])
    p = t.join(F.broadcast(centres), "k").select("k", "m", F.array_min(F.transform(F.filter("cs", lambda c: c["tier"] == F.col("tier")), gap)).alias("own"), F.array_min(F.transform(F.filter("cs", lambda c: c["tier"] != F.col("tier")), gap)).alias("other"))
    sil = F.when(F.greatest("own", "other") > 0, (F.col("other") - F.col("own")) / F.greatest("own", "other")).otherwise(0.0)
    s = p.groupBy("k").agg(F.sum(F.col("own") * F.col("own")).alias("inertia"), F.round(F.avg(sil), 9).alias("silhouette"), F.first("m").alias("m"))
    b = g.join(F.broadcast(f.agg(F.avg("x").alias("mean")))).groupBy("k").agg(F.sum(F.col("n") * (F.col("c") - F.col("mean")) ** 2).alias("b"))
    return K.choose_k(s.join(b, "k").select("k", "inertia", "silhouette", ((F.col("b") / (F.col("k") - 1)) / (F.col("inertia") / (F.col("m") - F.col("k")))).alias("ch")))


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    """k, inertia, silhouette, ch, db for k = 2 .. 12, each the best of 20 starts; the silhouette is over 1,000 skus by hash."""
    points, inertia = M.fit_all(_z(spark, sf), "sku", FEATURES, [M.Fit(str(k), k) for k in _TIERS], 500, 1e-4, True)
    sil = K.sampled_silhouettes(points, "sku", FEATURES, "cluster", "fit", len(inertia), 1000)
    costs = spark.createDataFrame([(f, c) for f, c in inertia.items()], "fit string, inertia double")  # a row for each k
    q = K.quality(points, FEATURES, "cluster", ["fit"]).join(sil, "fit").join(F.broadcast(costs), "fit")
    return q.select(F.col("fit").cast("int").alias("k"), "inertia", "silhouette", F.col("calinski_harabasz").alias("ch"), F.col("davies_bouldin").alias("db"))


@query("chosen_k_of_sweep")
def chosen_k_of_sweep(spark, sf):
    """choose_k's rule on what kmeans_sweep found."""
    return K.choose_k(kmeans_sweep(spark, sf))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return _clusters(spark, sf)


@query("cluster_profiles")
def cluster_profiles(spark, sf):
    part = V.read_table(spark, sf, "part").select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("category"))
    df = _clusters(spark, sf).join(classes(spark, sf), "sku").join(part, "sku")
    return K.profiles(df, "cluster", ["mean_demand", "total_revenue", "cv"], ["category", "abc"], "mean_demand", NAMES)


@query("profile_names", f"WITH {_FEATURES}, {_CLASSES}, g AS (SELECT abc, count(*) AS n, avg(mean_demand) AS m FROM cls GROUP BY abc), md AS (SELECT abc, xyz FROM (SELECT abc, xyz, count(*) AS c FROM cls GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY abc ORDER BY c DESC, xyz) = 1) SELECT abc, n, round(m, 6) AS mean_demand, xyz, ['Low-Velocity / Low-Value', 'Low-Velocity / High-Value', 'High-Velocity / Low-Value', 'High-Velocity / High-Value'][row_number() OVER (ORDER BY m, abc)] AS name FROM g JOIN md USING (abc)")
def profile_names(spark, sf):
    return K.profiles(classes(spark, sf), "abc", ["mean_demand"], ["xyz"], "mean_demand", NAMES).withColumn("mean_demand", F.round("mean_demand", 6))


@query("profile_radar", f"WITH {_FEATURES}, {_CLASSES}, g AS (SELECT abc, avg(mean_demand) AS m, avg(frequency) AS f FROM cls GROUP BY abc) SELECT abc, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER () + 1e-9), 6) AS mean_demand, round((f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER () + 1e-9), 6) AS frequency FROM g")
def profile_radar(spark, sf):
    g = classes(spark, sf).groupBy("abc").agg(F.avg("mean_demand").alias("mean_demand"), F.avg("frequency").alias("frequency"))
    return K.min_max(g, ["mean_demand", "frequency"]).withColumns({c: F.round(c, 6) for c in ("mean_demand", "frequency")})


@query("pca_projection")
def pca_projection(spark, sf):
    c, shares = K.pca(K.assembled(_z(spark, sf), "sku", FEATURES), "sku")
    return c.withColumns({"share_1": F.lit(shares[0]), "share_2": F.lit(shares[1])})


@query("ward_clusters")
def ward_clusters(spark, sf):
    return K.ward(_z(spark, sf).cache(), "sku", FEATURES)


@query("seed_stability")
def seed_stability(spark, sf):
    """20 seeds, each the best of 20 starts of its own; all 400 starts in one run."""
    runs, _ = M.fit_all(_z(spark, sf), "sku", FEATURES, [M.Fit(f"{s:02d}", 4, 20, 1000 * s) for s in range(20)])
    runs = runs.withColumn("run", F.col("fit").cast("int"))
    return K.pairwise_agreement(runs, "sku", "run", "cluster").agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.min("ari").alias("min_ari"), (F.count_if(F.col("ari") > 0.95) / F.count("*")).alias("share_above_95"), F.avg(F.when(F.col("run_a") == 0, F.col("ari"))).alias("mean_against_first"))


def _silhouette(clustered, features):
    return K.silhouette(clustered, "sku", features, "cluster", 1000).agg(F.avg("silhouette").alias("silhouette"))


@query("feature_ablation")
def feature_ablation(spark, sf):
    """dropped, ari against all features, silhouette (over 1,000 skus) in the features that are left; each fit the best of 20 starts, all in one run."""
    z = _z(spark, sf)
    labels, _ = M.fit_all(z, "sku", FEATURES, [M.Fit("all", 4), *(M.Fit(f, 4, without=(f,)) for f in FEATURES)])
    base = labels.where("fit = 'all'").select("sku", F.col("cluster").alias("base"))
    out = []
    for f in FEATURES:
        left = [x for x in FEATURES if x != f]
        c = labels.where(F.col("fit") == f).select("sku", "cluster")
        ari = K.agreement(base.join(c, "sku"), "base", "cluster")
        out.append(ari.join(F.broadcast(_silhouette(z.join(c, "sku"), left))).select(F.lit(f[:-2]).alias("dropped"), "ari", "silhouette"))
    return reduce(DataFrame.unionByName, out)


@query("outlier_sensitivity")
def outlier_sensitivity(spark, sf):
    """n, ari and the silhouettes (over 1,000 skus) with all skus and without those above the 99 % quantile of revenue."""
    f = features(spark, sf).cache()
    cut = f.agg(F.percentile("total_revenue", F.lit(0.99)).alias("cut"))
    kept = f.join(F.broadcast(cut)).filter(F.col("total_revenue") <= F.col("cut")).drop("cut")
    all_, left = (S.z_scores(x, S.FEATURES).select("sku", *FEATURES) for x in (f, kept))
    a, b = (M.fit_all(z, "sku", FEATURES, [M.Fit("k", 4)])[0].drop("fit") for z in (all_, left))
    ari = K.agreement(a.join(b.withColumnRenamed("cluster", "other"), "sku"), "cluster", "other").select("n", "ari")
    sils = [_silhouette(z.join(c, "sku"), FEATURES).withColumnRenamed("silhouette", n) for z, c, n in ((all_, a, "silhouette_all"), (left, b, "silhouette_without"))]
    return ari.join(F.broadcast(sils[0])).join(F.broadcast(sils[1]))


@query("revenue_p99", "WITH r AS (SELECT sku, CAST(sum(revenue) AS DOUBLE) AS v FROM demand GROUP BY sku) SELECT round(quantile_cont(v, 0.99), 4) AS p99, round(median(v), 4) AS median FROM r")
def revenue_p99(spark, sf):
    r = V.facts(spark, sf).groupBy("sku").agg(F.sum("revenue").cast("double").alias("v"))
    return r.agg(F.round(F.percentile("v", F.lit(0.99)), 4).alias("p99"), F.round(F.median("v"), 4).alias("median"))
