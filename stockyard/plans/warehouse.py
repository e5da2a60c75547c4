from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.operators import panel as P
from stockyard.operators import routing as R
from stockyard.plans.catalog import query
from stockyard.sources import views as V

_POS = "CAST(sku % 22 AS DOUBLE) AS x, CAST((sku // 22) % 20 AS DOUBLE) AS y, CAST(1 + sku % 5 AS DOUBLE) AS z"


def _stops(spark, sf):
    return V.sessions(spark, sf).select("session", F.transform("skus", R.grid_position).alias("stops"))


@query("pick_sessions", "SELECT session, count(*) AS n_stops, min(sku) AS first_sku, max(sku) AS last_sku, string_agg(CAST(sku AS VARCHAR), ',' ORDER BY sku) AS skus FROM sessions GROUP BY session")
def pick_sessions(spark, sf):
    return V.sessions(spark, sf).select("session", F.size("skus").cast("bigint").alias("n_stops"), F.array_min("skus").alias("first_sku"), F.array_max("skus").alias("last_sku"), F.array_join("skus", ",").alias("skus"))


@query("pick_sessions_json", "SELECT session, CAST(count(*) AS BIGINT) AS n FROM sessions GROUP BY session")
def pick_sessions_json(spark, sf):
    """JSON lists out and in again."""
    s = V.sessions(spark, sf).select("session", F.to_json("skus").alias("j"))
    return s.select("session", F.size(F.from_json("j", "array<bigint>")).cast("bigint").alias("n"))


@query(
    "naive_route_length",
    f"""WITH p AS (SELECT session, sku, {_POS} FROM sessions), s AS (SELECT session, sku, x, y, z, coalesce(lag(x) OVER w, 0) AS px, coalesce(lag(y) OVER w, 0) AS py, coalesce(lag(z) OVER w, 1) AS pz FROM p WINDOW w AS (PARTITION BY session ORDER BY sku))
SELECT session, round(sum(sqrt((x-px)*(x-px) + (y-py)*(y-py)) + 2*abs(z-pz)), 6) AS distance FROM s GROUP BY session""",
)
def naive_route_length(spark, sf):
    return _stops(spark, sf).select("session", F.round(R.path_length(F.col("stops")), 6).alias("distance"))


@query("routes")
def routes(spark, sf):
    return R.routes(_stops(spark, sf))


@query("route_gaps")
def route_gaps(spark, sf):
    return R.route_gaps(R.routes(_stops(spark, sf)))


_PICKS = "picks AS (SELECT sku, count(*) AS n FROM sessions GROUP BY sku), pi AS (SELECT *, row_number() OVER (ORDER BY n DESC, sku) - 1 AS i FROM picks), slots AS (SELECT s AS slot, CAST(s % 22 AS DOUBLE) AS x, CAST(s // 22 AS DOUBLE) AS y, CASE WHEN s < 320 THEN 'Pick_Face' WHEN s < 560 THEN 'Reserve' ELSE 'Bulk' END AS zone FROM range(720) r(s))"


def _slots(spark):
    s = F.col("id")
    return spark.range(720).select(s.alias("slot"), (s % 22).cast("double").alias("x"), F.floor(s / 22).cast("double").alias("y"), F.when(s < 320, "Pick_Face").when(s < 560, "Reserve").otherwise("Bulk").alias("zone"))


def _picks(spark, sf):
    return V.sessions(spark, sf).select(F.explode("skus").alias("sku")).groupBy("sku").agg(F.count("*").alias("n"))


@query("current_slotting", f"WITH {_PICKS}, si AS (SELECT *, row_number() OVER (ORDER BY zone, x, y) - 1 AS j FROM slots) SELECT sku, n, slot, zone, round(abs(x - 4.5) + 0.1 * y, 6) AS depot_distance FROM pi JOIN si ON i % 720 = j")
def current_slotting(spark, sf):
    a = R.cyclic_assignment(_picks(spark, sf), _slots(spark), [F.desc("n"), F.col("sku")], [F.col("zone"), F.col("x"), F.col("y")])
    return a.select("sku", "n", "slot", "zone", F.round(R.depot_distance(F.col("x"), F.col("y")), 6).alias("depot_distance"))


_ZONES = [("Pick_Face", 320), ("Reserve", 240), ("Bulk", 160)]


@query("greedy_slotting", f"WITH {_PICKS} SELECT sku, n, CASE WHEN i < 320 THEN 'Pick_Face' WHEN i < 560 THEN 'Reserve' ELSE 'Bulk' END AS zone FROM pi")
def greedy_slotting(spark, sf):
    return R.greedy_zones(_picks(spark, sf), _ZONES, [F.desc("n"), F.col("sku")])


def _travel(spark, sf, method):
    """Mean route over sessions when each zone's skus take its slots, nearest first."""
    if method == "current":
        at = R.cyclic_assignment(_picks(spark, sf), _slots(spark), [F.desc("n"), F.col("sku")], [F.col("zone"), F.col("x"), F.col("y")])
    else:
        order = [F.desc("n"), F.col("sku")]
        zoned = R.greedy_zones(_picks(spark, sf), _ZONES, order) if method == "greedy" else R.joint_then_greedy(_picks(spark, sf), _joint(spark, sf)[0], _ZONES, order)
        at = R.cyclic_assignment(zoned, _slots(spark), [F.desc("n"), F.col("sku")], [R.depot_distance(F.col("x"), F.col("y")), F.col("slot")], ["zone"])
    place = at.select("sku", F.struct("x", "y", F.lit(1.0).alias("z")).alias("p"))
    stops = V.sessions(spark, sf).select("session", F.explode("skus").alias("sku")).join(place, "sku").groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("sku", "p"))), lambda s: s["p"]).alias("stops"))
    return R.routes(stops, exact_most=0, depot=(4.5, 0.0, 1.0)).agg(F.avg("nearest").alias("mean_travel"), F.count("*").alias("sessions")).withColumn("method", F.lit(method))


@query("slotting_comparison")
def slotting_comparison(spark, sf):
    all_ = _travel(spark, sf, "current").unionByName(_travel(spark, sf, "greedy")).unionByName(_travel(spark, sf, "joint"))
    base = F.max(F.when(F.col("method") == "current", F.col("mean_travel"))).over(Window.partitionBy())
    return all_.withColumn("reduction_pct", 100 * (base - F.col("mean_travel")) / base)


def _joint(spark, sf):
    """A stated few items and pairs (200 and 50, as parameters of the model), solved on the driver: zones, objective, bound."""
    from stockyard.operators import affinity as A

    items = [(r.sku, float(r.n)) for r in _picks(spark, sf).orderBy(F.desc("n"), "sku").limit(200).collect()]
    pairs = [(r.a, r.b, float(r.lift)) for r in A.top_pairs(A.pairs_with_lift(V.sessions(spark, sf), 0.0001), 50).collect()]
    return R.joint_zones(items, pairs, [("Pick_Face", 320, 1.0), ("Reserve", 240, 2.0), ("Bulk", 160, 3.0)])


@query("joint_slotting")
def joint_slotting(spark, sf):
    """The joint plan of the stated few items; the result says how near its bound it is."""
    at, value, bound = _joint(spark, sf)
    return spark.createDataFrame([(i, z, value, bound) for i, z in sorted(at.items())], "sku bigint, zone string, objective double, bound double")


# Stability


def _quarters(spark, sf):
    f = V.facts(spark, sf).select("sku", F.trunc("date", "quarter").alias("quarter"), "qty")
    q = f.groupBy("quarter", "sku").agg(F.sum("qty").alias("q"))
    w = Window.partitionBy("quarter")
    q = q.withColumn("rank", F.row_number().over(w.orderBy(F.desc("q"), "sku"))).withColumn("share", F.col("rank") / F.count("*").over(w))
    return q.withColumn("tier", F.when(F.col("share") <= 0.25, "A").when(F.col("share") <= 0.5, "B").when(F.col("share") <= 0.75, "C").otherwise("D"))


_QUARTERS = """q0 AS (SELECT sku, date_trunc('quarter', date)::DATE AS quarter, sum(qty) AS q FROM demand GROUP BY ALL), q1 AS (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY q DESC, sku) AS rank, count(*) OVER (PARTITION BY quarter) AS m FROM q0),
qt AS (SELECT quarter, sku, q, rank, rank / m AS share, CASE WHEN rank / m <= 0.25 THEN 'A' WHEN rank / m <= 0.5 THEN 'B' WHEN rank / m <= 0.75 THEN 'C' ELSE 'D' END AS tier FROM q1)"""


@query("quarter_tiers", f"WITH {_QUARTERS} SELECT quarter, tier, count(*) AS n, CAST(sum(q) AS DOUBLE) AS qty FROM qt GROUP BY ALL")
def quarter_tiers(spark, sf):
    return _quarters(spark, sf).groupBy("quarter", "tier").agg(F.count("*").alias("n"), F.sum("q").alias("qty"))


def _stability(spark, sf):
    q = _quarters(spark, sf)
    nxt = q.select(F.add_months("quarter", -3).alias("quarter"), "sku", F.col("rank").alias("rank2"), F.col("tier").alias("tier2"))
    both = q.join(nxt, ["quarter", "sku"])
    r = both.select("quarter", "tier", "tier2", P.average_rank("rank", ["quarter"]).alias("a"), P.average_rank("rank2", ["quarter"]).alias("b"))
    return r.groupBy("quarter").agg(F.count("*").alias("common"), F.corr("a", "b").alias("rho"), (100 * F.count_if(F.col("tier") != F.col("tier2")) / F.count("*")).alias("pct_changed")).filter("common >= 10")


_STAB = f"{_QUARTERS}, bo AS (SELECT a.quarter, a.sku, a.rank AS r1, b.rank AS r2, a.tier AS t1, b.tier AS t2 FROM qt a JOIN qt b ON a.sku = b.sku AND b.quarter = a.quarter + INTERVAL 3 MONTH), rk AS (SELECT quarter, t1, t2, rank() OVER (PARTITION BY quarter ORDER BY r1) AS a, rank() OVER (PARTITION BY quarter ORDER BY r2) AS b FROM bo), st AS (SELECT quarter, count(*) AS common, corr(a, b) AS rho, 100.0 * count_if(t1 <> t2) / count(*) AS pct_changed FROM rk GROUP BY quarter HAVING count(*) >= 10)"


@query("quarter_stability", f"WITH {_STAB} SELECT quarter, common, round(rho, 6) AS rho, round(pct_changed, 4) AS pct_changed FROM st")
def quarter_stability(spark, sf):
    return _stability(spark, sf).withColumns({"rho": F.round("rho", 6), "pct_changed": F.round("pct_changed", 4)})


@query("reslotting_cadence", f"WITH {_STAB}, m AS (SELECT avg(rho) AS rho, avg(pct_changed) AS pct FROM st) SELECT round(rho, 6) AS mean_rho, round(pct, 4) AS mean_pct_changed, CASE WHEN rho > 0.95 AND pct < 10 THEN 'quarterly' WHEN rho > 0.85 AND pct < 20 THEN 'semi-annual' ELSE 'monthly' END AS cadence FROM m")
def reslotting_cadence(spark, sf):
    m = _stability(spark, sf).agg(F.avg("rho").alias("r"), F.avg("pct_changed").alias("p"))
    return m.select(F.round("r", 6).alias("mean_rho"), F.round("p", 4).alias("mean_pct_changed"), F.when((F.col("r") > 0.95) & (F.col("p") < 10), "quarterly").when((F.col("r") > 0.85) & (F.col("p") < 20), "semi-annual").otherwise("monthly").alias("cadence"))


@query(
    "quarter_pair_overlap",
    """WITH b AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS quarter, session, sku FROM sessions JOIN orders ON session = o_orderkey), p AS (SELECT x.quarter, x.sku AS a, y.sku AS b, count(*) AS c FROM b x JOIN b y ON x.session = y.session AND x.sku < y.sku GROUP BY ALL),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY quarter ORDER BY c DESC, a, b) <= 50) SELECT t.quarter, count(u.a) / 50 AS overlap FROM t LEFT JOIN t u ON u.quarter = t.quarter + INTERVAL 3 MONTH AND u.a = t.a AND u.b = t.b GROUP BY t.quarter""",
)
def quarter_pair_overlap(spark, sf):
    orders = V.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.trunc("o_orderdate", "quarter").alias("quarter"))
    s = V.sessions(spark, sf).join(orders, "session")
    pairs = F.flatten(F.transform("skus", lambda a, i: F.transform(F.slice("skus", i + 2, F.size("skus")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = s.select("quarter", F.explode(pairs).alias("p")).groupBy("quarter", "p.a", "p.b").agg(F.count("*").alias("c"))
    t = p.withColumn("r", F.row_number().over(Window.partitionBy("quarter").orderBy(F.desc("c"), "a", "b"))).filter("r <= 50").select("quarter", "a", "b")
    u = t.select(F.add_months("quarter", -3).alias("quarter"), "a", "b", F.lit(1).alias("hit"))
    return t.join(u, ["quarter", "a", "b"], "left").groupBy("quarter").agg((F.count("hit") / 50).alias("overlap"))
