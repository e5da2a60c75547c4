import datetime

from pyspark.sql import functions as F

from stockyard.operators import rfm as R
from stockyard.plans.catalog import query
from stockyard.sources import views as V

REFERENCE = datetime.date(2001, 12, 31)
_RULES = " ".join("WHEN " + " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in zip("rfm", b, strict=True)) + f" THEN '{n}'" for n, *b in R.SEGMENTS)
_SCORED = f"""base AS (SELECT customer, date_diff('day', max(date), DATE '{REFERENCE}') AS recency, count(*) AS frequency, sum(revenue) AS monetary FROM sales GROUP BY customer),
ranked AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency, customer) AS rr, row_number() OVER (ORDER BY frequency, customer) AS fr, row_number() OVER (ORDER BY monetary, customer) AS mr FROM base),
scored AS (SELECT customer, recency, frequency, monetary, CAST(6 - (5*rr + n - 1) // n AS INT) AS r, CAST((5*fr + n - 1) // n AS INT) AS f, CAST((5*mr + n - 1) // n AS INT) AS m FROM ranked),
seg AS (SELECT *, CASE {_RULES} ELSE 'Others' END AS segment FROM scored)"""


def _segments(spark, sf):
    return R.segments(V.sales(spark, sf), REFERENCE)


@query("rfm_segments", f"WITH {_SCORED} SELECT customer, CAST(recency AS INT) AS recency, frequency, CAST(monetary AS DOUBLE) AS monetary, r, f, m, r + f + m AS rfm_sum, concat(r, f, m) AS rfm_code, segment FROM seg")
def rfm_segments(spark, sf):
    return _segments(spark, sf).withColumn("monetary", F.col("monetary").cast("double"))


@query("rfm_population", f"WITH {_SCORED} SELECT segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM seg GROUP BY segment")
def rfm_population(spark, sf):
    return R.population(_segments(spark, sf)).withColumn("pct", F.round("pct", 4))


@query(
    "rfm_spearman",
    f"""WITH {_SCORED}, rk AS (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS r, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS f, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS m FROM scored),
c AS (SELECT 'r' AS a, 'f' AS b, count(*) AS n, corr(r::DOUBLE, f::DOUBLE) AS rho FROM rk UNION ALL SELECT 'r', 'm', count(*), corr(r::DOUBLE, m::DOUBLE) FROM rk UNION ALL SELECT 'f', 'm', count(*), corr(f::DOUBLE, m::DOUBLE) FROM rk)
SELECT a, b, n, round(rho, 6) AS rho, abs(rho) > 0.3 AS flagged FROM c""",
)
def rfm_spearman(spark, sf):
    return R.spearman(_segments(spark, sf), [("r", "f"), ("r", "m"), ("f", "m")]).withColumn("rho", F.round("rho", 6))


@query("rfm_boundary_bootstrap")
def rfm_boundary_bootstrap(spark, sf):
    return R.boundary_stability(R.rfm(V.sales(spark, sf), REFERENCE), "monetary")
