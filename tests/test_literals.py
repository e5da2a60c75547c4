"""Small literal cases with values worked out from the definitions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.functions import tails
from stockyard.operators import affinity, anomaly, cluster, control, experiment, forecast, panel, rfm, routing, sampling, segment


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_quintile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "k int, x double")
    got = [r.s for r in df.select("k", panel.first_rank_quintile(F.col("x"), "k").alias("s")).orderBy("k").collect()]
    assert got == [1, 2, 3, 3, 4, 5, 5]


def test_quintile_sizes_differ_by_one(spark):
    df = spark.range(398).select(F.col("id").alias("k"), F.col("id").alias("x"))
    n = [r["count"] for r in df.select(panel.first_rank_quintile(F.col("x"), "k").alias("s")).groupBy("s").count().orderBy("s").collect()]
    assert n == [79, 80, 79, 80, 80] or (sum(n) == 398 and max(n) - min(n) <= 1)


def test_percentile_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 5, 5, 9)], "x double")
    got = sorted(round(r.p, 4) for r in df.select(panel.percentile_rank("x").alias("p")).collect())
    assert got == [0.2143, 0.2143, 0.4286, 0.7143, 0.7143, 0.7143, 1.0]


def test_abc(spark):
    df = spark.createDataFrame([(1, 60.0), (2, 20.0), (3, 12.0), (4, 8.0)], "sku int, total_revenue double")
    assert [r.abc for r in segment.abc(df).orderBy("sku").collect()] == ["A", "B", "C", "C"]


def _parts(spark, values, test=1):
    rows = [("a", day(i), float(v), i, len(values), i < len(values) - test) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, date date, q double, t int, n int, train boolean")


def test_croston(spark):
    r = forecast.croston(_parts(spark, [0, 3, 0, 0, 5, 2, 0, 9])).first()
    assert (r.size, r.interval) == pytest.approx((3.08, 1.18)) and r.croston == pytest.approx(2.610169, abs=1e-6) and r.sba == pytest.approx(2.479661, abs=1e-6)


def test_croston_without_demand(spark):
    assert forecast.croston(_parts(spark, [0, 0, 0, 9])).first().croston == 0


def test_ses(spark):
    df = spark.createDataFrame([([10.0, 12.0, 11.0, 15.0],)], "qs array<double>")
    level, _ = forecast.ses_level(F.col("qs"), F.lit(0.3), F.lit(10.0))
    assert df.select(level.alias("l")).first().l == pytest.approx(12.004)


def test_accuracy(spark):
    rows = [("a", "m", a, f) for a, f in zip((10.0, 0.0, 5.0, 20.0), (8.0, 1.0, 5.0, 25.0), strict=True)]
    r = forecast.accuracy(spark.createDataFrame(rows, "k string, model string, q double, forecast double")).first()
    assert (r.mape, r.rmse, r.mae, r.bias) == pytest.approx((15, 2.738613, 2, 1), abs=1e-6)


def test_accuracy_without_demand(spark):
    assert forecast.accuracy(spark.createDataFrame([("a", "m", 0.0, 1.0)], "k string, model string, q double, forecast double")).first().mape is None


def _long(spark, xs, mu=None, sd=None):
    return spark.createDataFrame([(0, day(i), "m", None if x is None else float(x), mu, sd) for i, x in enumerate(xs)], "warehouse int, date date, metric string, x double, mu double, sd double")


def test_cusum(spark):
    rows = control.cusum(_long(spark, [0, 1.5, 2, 2, 1, -1, -3, -3], 0.0, 1.0)).orderBy("date").collect()
    assert [r.c_plus for r in rows] == [0, 1, 2.5, 4, 0, 0, 0, 0]
    assert [r.c_minus for r in rows] == [0, 0, 0, 0, 0, 0.5, 3, 0]
    assert [r.alarm for r in rows] == [False, False, False, False, True, False, False, True]


def test_rule4(spark):
    for xs, want in (([1, 2, 3, 4, 5, 6], True), ([1, 2, 3, 4, 5, 5], False)):
        assert control.run_rules(_long(spark, xs, 3.0, 10.0)).orderBy(F.desc("date")).first().rule4 is want


def test_rule3_counts_equality_as_not_above(spark):
    assert control.run_rules(_long(spark, [3] * 8, 3.0, 1.0)).orderBy(F.desc("date")).first().rule3


def test_rules_1_and_2(spark):
    rows = control.run_rules(_long(spark, [0, 2.5, 2.5, 3.5], 0.0, 1.0)).orderBy("date").collect()
    assert [r.rule1 for r in rows] == [False, False, False, True] and [r.rule2 for r in rows] == [False, False, True, True]


def test_agreement(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], strict=True)), "u int, v int")
    r = segment.agreement(df, "u", "v").first()
    assert (r.ari, r.nmi) == pytest.approx((0.242424, 0.515804), abs=1e-6)
    assert segment.agreement(df, "u", "u").first().ari == pytest.approx(1)


def test_overlap(spark):
    df = spark.createDataFrame([(a == "1", b == "1") for a, b in zip("11001000", "10001100", strict=True)], "a boolean, b boolean")
    r = anomaly.overlap(df, [("a", "b")]).first()
    assert (r.kappa, r.jaccard) == pytest.approx((0.466667, 0.5), abs=1e-6)


def test_route(spark):
    stops = [(5.0, 1.0, 1.0), (1.0, 4.0, 1.0), (2.0, 1.0, 2.0), (6.0, 5.0, 1.0)]
    df = spark.createDataFrame([(1, stops)], "session bigint, stops array<struct<x:double,y:double,z:double>>")
    r = routing.routes(df).first()
    assert (r.naive, r.nearest, r.exact) == pytest.approx((22.918151, 20.903066, 18.345231), abs=1e-6)
    assert r.exact <= r.two_opt <= r.nearest
    assert df.select(routing.path_length(F.col("stops")).alias("d")).first().d == pytest.approx(22.918151, abs=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_searches_improve(seed):
    m = routing._matrix(np.random.default_rng(seed).uniform(0, 20, (7, 3)), routing.DEPOT)
    nn = routing.nearest_neighbour(m)
    assert routing.exact_length(m) <= routing._length(m, routing.two_opt(m, nn)) + 1e-9 <= routing._length(m, nn) + 2e-9


def test_affinity(spark):
    baskets = [["A", "B"], ["A", "B"], ["A"], ["A"], ["B"], *[["C"]] * 15]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "session int, skus array<string>")
    r = affinity.validated(affinity.pairs_with_lift(df)).filter("a = 'A' and b = 'B'").first()
    assert r.lift == pytest.approx(3.333333, abs=1e-6) and r.p == pytest.approx(0.087719, abs=1e-6) and not r.validated


def test_two_proportions(spark):
    r = spark.range(1).select(experiment.two_proportions(*[F.lit(float(x)) for x in (45, 46, 38, 46)]).alias("r")).select("r.*").first()
    assert (r.z, r.low, r.high) == pytest.approx((2.456584, 0.034811, 0.269537), abs=1e-6)
    assert tails.normal_two_sided(r.z) == pytest.approx(0.014026, abs=1e-6)


def test_power():
    assert tails.n_per_arm(79 / 95, 79 / 95 + 0.05) == pytest.approx(765.98, abs=0.01)
    assert tails.detectable(79 / 95, 47) == pytest.approx(0.150593, abs=1e-6)
    assert tails.power_two_sided(tails.cohen_h(45 / 46, 38 / 46), 46) == pytest.approx(0.772, abs=1e-3)


def test_tails():
    assert tails.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert tails.t_two_sided(2.016, 111) == pytest.approx(0.0462, abs=1e-4)
    assert tails.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert tails.f_upper(3.098, 3, 20) == pytest.approx(0.05, abs=1e-4)
    assert tails.hypergeometric_upper(0, 20, 4, 3) == pytest.approx(1)


def test_ward_and_quality(spark):
    g = np.random.default_rng(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([g.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))]))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    for groups in (400, 12):  # each point on its own, then cells
        cut = cluster.ward(df, "id", ["x", "y"], (3,), groups)
        assert cut.count() == 60 and segment.agreement(df.select("id", F.floor(F.col("id") / 20).alias("t")).join(cut, "id"), "t", "cluster").first().ari == pytest.approx(1)
    w = cluster.ward(df, "id", ["x", "y"], (3,))
    truth = df.select("id", F.floor(F.col("id") / 20).alias("t")).join(w, "id")
    assert segment.agreement(truth, "t", "cluster").first().ari == pytest.approx(1)
    km, _ = cluster.kmeans(cluster.assembled(df, "id", ["x", "y"]), "id", 3)
    assert segment.agreement(truth.drop("cluster").join(km, "id"), "t", "cluster").first().ari == pytest.approx(1)


def test_adf_tells_an_autoregression_from_a_walk():
    g = np.random.default_rng(3)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.8 * y[t - 1] + g.normal()
    assert forecast.adf(y)[1] < 0.05 < forecast.adf(np.cumsum(g.normal(size=400)))[1]


def test_pacf_of_an_autoregression(spark):
    rows = [("a", i, 0.6**i, 0.1) for i in range(6)]
    got = [r.pacf for r in forecast.pacf(spark.createDataFrame(rows, "k string, lag int, acf double, band double")).orderBy("lag").collect()]
    assert got[:2] == pytest.approx([1, 0.6]) and max(map(abs, got[2:])) < 1e-9


def test_densify(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("b", day(3), 2.0)], "k string, date date, q double")
    rows = panel.densify(df).collect()
    assert len(rows) == 8 and sum(r.q for r in rows) == 3


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("s", F.col("k") % 4)
    assert {r.k for r in sampling.simple(df, "k", 50).collect()} == {r.k for r in sampling.simple(df.repartition(13), "k", 50).collect()}
    assert sampling.bootstrap(df, "k").count() == 1000
    n = {r.s: r["count"] for r in sampling.stratified(df, "k", "s", 100).groupBy("s").count().collect()}
    assert n == {0: 25, 1: 25, 2: 25, 3: 25}


def test_assignment(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(95)], "customer int, type string")
    got = experiment.assign(df, "type", 47).groupBy("arm").count().collect()
    assert {r.arm: r["count"] for r in got}["Treatment"] <= 47 and len(got) == 2


def test_joint_slotting_meets_its_bound_when_nothing_binds():
    at, value, bound = routing.joint_zones([(1, 5.0), (2, 3.0), (3, 1.0)], [(1, 2, 2.0)], [("near", 10, 1.0), ("far", 10, 2.0)])
    assert set(at.values()) == {"near"} and value == pytest.approx(bound)
    at, value, bound = routing.joint_zones([(1, 5.0), (2, 3.0), (3, 1.0)], [(1, 3, 50.0)], [("near", 2, 1.0), ("far", 10, 2.0)])
    assert at[1] == at[3] and value >= bound - 1e-9


def test_segments_cascade(spark):
    df = spark.createDataFrame([(5, 5, 5), (3, 5, 1), (4, 3, 3), (1, 3, 1), (1, 1, 1), (2, 2, 5), (3, 3, 3), (5, 1, 1), (3, 1, 3), (3, 3, 1)], "r int, f int, m int")
    got = [x.s for x in df.select(rfm.segment().alias("s")).collect()]
    assert got == ["Champions", "Loyal", "Potential Loyalist", "At Risk", "Lost Cheap", "Lost", "Needs Attention", "New Customers", "Promising", "Others"]


def test_lof_of_an_outlier(spark):
    rows = [(i, 0, float(i % 5), float(i // 5)) for i in range(25)] + [(25, 0, 50.0, 50.0)]
    got = anomaly.lof(spark.createDataFrame(rows, "id int, g int, x double, y double"), ["id"], ["x", "y"], ["g"], k=5).orderBy(F.desc("lof")).first()
    assert got.id == 25 and got.lof > 5 and not math.isnan(got.lof)


def test_joint_plan_is_placed(spark):
    skus = spark.createDataFrame([(i, 10 - i) for i in range(6)], "sku bigint, n bigint")
    z = routing.joint_then_greedy(skus, {0: "b", 3: "a"}, [("a", 2), ("b", 2), ("c", 9)], [F.desc("n"), F.col("sku")])
    assert {r.sku: r.zone for r in z.collect()} == {0: "b", 3: "a", 1: "a", 2: "b", 4: "c", 5: "c"}


def test_grid_is_evaluated_whole(spark, monkeypatch):
    from stockyard.plans import models

    fits = []

    class Model:
        def transform(self, df):
            return df.withColumn("forecast", F.lit(1.0))

    monkeypatch.setattr(models, "_panel", lambda *_: spark.createDataFrame([(day(i), 2.0, True) for i in range(40)], "date date, q double, train boolean"))
    monkeypatch.setattr(models, "_fit", lambda df, *p: (fits.append(p), Model())[1])
    rows = models.boosted_grid_cv(spark, None).collect()
    assert {(r.iterations, r.depth, r.step) for r in rows} == set(models.GRID)
    assert sorted(fits) == sorted([*models.GRID] * 3)


def test_sweep_is_whole(spark, monkeypatch):
    """All k from 2 to 12, each from 20 starts: four far groups have their elbow and their best silhouette at four."""
    import numpy as np

    from stockyard.plans import clustering

    r = np.random.default_rng(2)
    x = np.repeat(np.eye(4) * 20, 12, axis=0) @ r.normal(size=(4, 9)) + r.normal(0, 0.3, (48, 9))
    z = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "sku int, " + ", ".join(f"{c} double" for c in clustering.FEATURES))
    monkeypatch.setattr(clustering, "_z", lambda *_: z)
    fits = []
    fit_all = clustering.M.fit_all
    monkeypatch.setattr(clustering.M, "fit_all", lambda p, key, features, wanted, *a: (fits.extend(wanted), fit_all(p, key, features, wanted, *a))[1])
    sweep = clustering.kmeans_sweep(spark, None)
    rows = sorted(sweep.collect())
    assert sweep.columns == ["k", "inertia", "silhouette", "ch", "db"] and [r.k for r in rows] == list(range(2, 13)) == [f.k for f in fits] and {f.starts for f in fits} == {20}
    inertia = [r.inertia for r in rows]
    assert inertia == sorted(inertia, reverse=True) and max(rows, key=lambda r: r.silhouette).k == 4
    centres = x.reshape(4, 12, 9).mean(1)
    assert inertia[2] == pytest.approx(((x.reshape(4, 12, 9) - centres[:, None]) ** 2).sum())
    got = clustering.K.choose_k(spark.createDataFrame(rows, sweep.schema)).first()
    assert (got.k_chosen, got.k_elbow) == plain_choice([tuple(r)[:4] for r in rows])


def plain_choice(sweep):
    """The rule in a loop: peaks among k >= 3 only, else the best silhouette there; the elbow over all k."""
    late = [r for r in sorted(sweep) if r[0] >= 3]
    peaks = [late[i] for i in range(1, len(late) - 1) if late[i][2] > late[i - 1][2] and late[i][2] > late[i + 1][2]]
    chosen = max(peaks, key=lambda r: (r[3], -r[0])) if peaks else max(late, key=lambda r: (r[2], -r[0])) if late else None
    all_ = sorted(sweep)
    bends = [(-(all_[i + 1][1] - 2 * all_[i][1] + all_[i - 1][1]), -all_[i][0]) for i in range(1, len(all_) - 1)]
    return chosen and chosen[0], -max(bends)[1] if bends else None


@pytest.mark.parametrize("case", ["falling", "peak at 3", "random"])
def test_choice_of_k(spark, case):
    import random

    from stockyard.operators.cluster import choose_k

    r = random.Random(case)
    sweeps = {
        "falling": [[(k, 100.0 / k, 1.0 / k, 5.0) for k in range(2, 9)], [(2, 9.0, 0.9, 1.0)], [(2, 9.0, 0.9, 1.0), (3, 5.0, 0.1, 1.0), (4, 4.0, 0.1, 1.0)]],
        "peak at 3": [[(2, 9.0, 0.1, 9.0), (3, 7.0, 0.9, 9.0), (4, 6.0, 0.2, 9.0), (5, 5.0, 0.4, 1.0), (6, 4.0, 0.3, 2.0)]],
        "random": [[(k, float(r.randrange(90)), r.randrange(4) / 4, float(r.randrange(3))) for k in range(2, r.randrange(3, 13))] for _ in range(12)],
    }[case]
    for sweep in sweeps:
        got = choose_k(spark.createDataFrame(sweep, "k int, inertia double, silhouette double, ch double")).first()
        assert (got.k_chosen, got.k_elbow) == plain_choice(sweep), sweep


def test_decomposition_to_the_ends(spark):
    """A straight line and a weekly pattern come apart exactly, also in the first and last days."""
    week = [3, -1, 0, 2, -2, -3, 1]
    rows = [("a", day(i), 10 + 0.5 * i + week[i % 7]) for i in range(35)]
    for r in forecast.decompose(spark.createDataFrame(rows, "k string, date date, q double")).collect():
        i = (r.date - day(0)).days
        assert (r.trend, r.seasonal, r.residual) == pytest.approx((10 + 0.5 * i, week[i % 7], 0), abs=1e-9)


def test_qq_points_are_normal_quantiles(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([("a", day(i), float(x)) for i, x in enumerate([5, 1, 4, 2, 3])], "k string, date date, residual double")
    got = sorted((r.y, r.x) for r in forecast.qq_points(df).collect())
    assert [y for y, _ in got] == [1, 2, 3, 4, 5] and [x for _, x in got] == pytest.approx([NormalDist().inv_cdf((i + 0.5) / 5) for i in range(5)])


def test_pca_equals_the_eigenvectors(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(80, 4)) @ np.diag([3.0, 2.0, 1.0, 0.5])
    x -= x.mean(0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got, shares = cluster.pca(cluster.assembled(df, "id", list("abcd")), "id")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert shares == pytest.approx((values[::-1] / values.sum())[:2])
    for r in got.collect():
        assert (abs(r.c1), abs(r.c2)) == pytest.approx(tuple(np.abs(x[r.id] @ vectors[:, ::-1][:, :2])), abs=1e-9)


def test_clusters_are_a_fixed_point(spark):
    """Every point is nearest to the mean of its own cluster."""
    g = np.random.default_rng(6)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([g.normal(c, 0.3, (30, 2)) for c in ((0, 0), (6, 6), (0, 6), (6, 0))]))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    c, inertia = cluster.kmeans(cluster.assembled(df, "id", ["x", "y"]), "id", 4)
    of = {r.id: r.cluster for r in c.collect()}
    x = np.array([r[1:] for r in rows])
    lab = np.array([of[i] for i in range(len(rows))])
    means = np.array([x[lab == k].mean(0) for k in range(4)])
    d = ((x[:, None] - means[None]) ** 2).sum(2)
    assert (d.argmin(1) == lab).all() and inertia == pytest.approx(d.min(1).sum())


def test_pairwise_agreement(spark):
    runs = {0: [0, 0, 1, 1, 2, 2], 1: [1, 1, 0, 0, 2, 2], 2: [0, 0, 0, 1, 1, 1]}
    df = spark.createDataFrame([(i, r, c) for r, cs in runs.items() for i, c in enumerate(cs)], "sku int, run int, cluster int")
    got = {(r.run_a, r.run_b): r.ari for r in cluster.pairwise_agreement(df, "sku", "run", "cluster").collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] == got[1, 2] == pytest.approx(0.242424, abs=1e-6)


def test_markdown_sink(spark, tmp_path):
    from stockyard.sources import files

    path = f"file://{tmp_path}/report.md"
    files.write_text(spark, files.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string"), "Rows"), path)
    files.write_text(spark, files.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string"), "Rows"), path)
    assert (tmp_path / "report.md").read_text() == "## Rows\n\n| n | s |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |\n"


def test_bootstrap_draws_by_position(spark):
    """Each draw is a row of the table, as many as there are, with repeats and gaps; a seed gives the same draws."""
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two, other = (sorted(r.k for r in sampling.bootstrap(df.repartition(n), "k", seed).collect()) for n, seed in ((2, 1), (7, 1), (2, 2)))
    assert one == two != other and len(one) == 500 and set(one) < set(range(500)) and 280 < len(set(one)) < 350
