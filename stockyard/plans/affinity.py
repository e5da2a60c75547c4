from pyspark.sql import functions as F

from stockyard.operators import affinity as A
from stockyard.plans.catalog import query
from stockyard.sources import views as V

_PAIRS = """one AS (SELECT sku, count(*) AS n FROM sessions GROUP BY sku), tot AS (SELECT count(DISTINCT session) AS n FROM sessions),
pr AS (SELECT x.sku AS a, y.sku AS b, count(*) AS together FROM sessions x JOIN sessions y ON x.session = y.session AND x.sku < y.sku GROUP BY ALL),
lifted AS (SELECT a, b, together, oa.n AS n_a, ob.n AS n_b, tot.n AS n, together / tot.n AS support, together / oa.n AS confidence, together * tot.n / (oa.n * ob.n) AS lift FROM pr, tot JOIN one oa ON oa.sku = a JOIN one ob ON ob.sku = b WHERE together >= greatest(2, floor(0.0001 * tot.n)))"""


@query("item_support", "SELECT sku, count(*) AS n FROM sessions GROUP BY sku")
def item_support(spark, sf):
    return A.supports(V.sessions(spark, sf))


@query("affinity_pairs", f"WITH {_PAIRS} SELECT a, b, together, n_a, n_b, n, round(support, 8) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM lifted")
def affinity_pairs(spark, sf):
    return A.pairs_with_lift(V.sessions(spark, sf), 0.0001).withColumns({"support": F.round("support", 8), "confidence": F.round("confidence", 6), "lift": F.round("lift", 6)})


@query("affinity_top", f"WITH {_PAIRS} SELECT a, b, together, round(lift, 6) AS lift FROM lifted ORDER BY lifted.lift DESC, together DESC, a, b LIMIT 200")
def affinity_top(spark, sf):
    return A.top_pairs(A.pairs_with_lift(V.sessions(spark, sf), 0.0001)).select("a", "b", "together", F.round("lift", 6).alias("lift"))


# The same law in SQL: logarithms of binomials, summed over all overlaps from `together` on.
_LC = lambda x, y: f"(lgamma(({x}) + 1.0) - lgamma(({y}) + 1.0) - lgamma(({x}) - ({y}) + 1.0))"
_HYPER = f"least(1, list_sum([exp({_LC('n_a', 'i')} + {_LC('n - n_a', 'n_b - i')} - {_LC('n', 'n_b')}) for i in range(greatest(together, n_a + n_b - n, 0)::BIGINT, least(n_a, n_b)::BIGINT + 1)]))"


@query("affinity_validated", f"WITH {_PAIRS}, top AS (SELECT * FROM lifted ORDER BY lift DESC, together DESC, a, b LIMIT 200), p AS (SELECT *, {_HYPER} AS p FROM top) SELECT a, b, together, n_a, n_b, n, round(lift, 6) AS lift, round(p, 8) AS p, p < 0.05 AS validated FROM p")
def affinity_validated(spark, sf):
    v = A.validated(A.top_pairs(A.pairs_with_lift(V.sessions(spark, sf), 0.0001)))
    return v.select("a", "b", "together", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("p", 8).alias("p"), "validated")
