"""The relational vocabulary on the tables themselves: projection, predicates, joins, aggregates, windows, sets, samples, files."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.operators import panel as P
from stockyard.operators import sampling as X
from stockyard.operators.running import running
from stockyard.plans.catalog import query
from stockyard.sources import files
from stockyard.sources import views as V


def _t(spark, sf, name):
    return V.read_table(spark, sf, name)


@query("project_rename_cast", "SELECT p_partkey AS sku, upper(p_brand) AS brand, p_retailprice * 2 - 1 AS list_price, CAST(p_size AS DOUBLE) AS size, 'part' AS kind, CAST(p_partkey AS VARCHAR) AS sku_text FROM part")
def project_rename_cast(spark, sf):
    p = _t(spark, sf, "part").withColumnRenamed("p_partkey", "sku").drop("p_type", "p_name")
    return p.select("sku", F.upper("p_brand").alias("brand"), (F.col("p_retailprice") * 2 - 1).alias("list_price"), F.col("p_size").cast("double").alias("size"), F.lit("part").alias("kind"), F.col("sku").cast("string").alias("sku_text"))


@query("recode_and_label", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS label FROM customer")
def recode_and_label(spark, sf):
    c = _t(spark, sf, "customer")
    codes = P.label_codes(c, "c_mktsegment", "label")
    return c.join(F.broadcast(codes), "c_mktsegment").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0).alias("code"), "label")


@query("predicates", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND (o_totalprice > 1000 AND NOT o_orderstatus = 'P' OR starts_with(o_orderpriority, '1')) AND o_orderstatus IN ('O', 'F', 'P') AND o_custkey IS NOT NULL AND contains(o_orderpriority, '-')")
def predicates(spark, sf):
    o = _t(spark, sf, "orders").filter(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    flag = ((F.col("o_totalprice") > 1000) & ~(F.col("o_orderstatus") == "P")) | F.col("o_orderpriority").startswith("1")
    return o.filter(flag & F.col("o_orderstatus").isin("O", "F", "P") & F.col("o_custkey").isNotNull() & F.col("o_orderpriority").contains("-")).select("o_orderkey", "o_orderpriority")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400)")
def semi_join(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders").filter("o_totalprice > 400"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def anti_join(spark, sf):
    return _t(spark, sf, "part").join(_t(spark, sf, "lineitem").filter("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("inner_join_totals", "SELECT n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def inner_join_totals(spark, sf):
    """Orders are summed by customer before the join, so the join moves customers, not orders."""
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    j = o.join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total"))


@query("left_join_chain", "WITH a AS (SELECT l_partkey AS k, l_suppkey % 3 AS w, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey AS k, l_suppkey % 3 AS w, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), c AS (SELECT l_partkey AS k, l_suppkey % 3 AS w, max(l_tax) AS tax FROM lineitem WHERE l_discount > 0.09 GROUP BY ALL) SELECT k, w, q, coalesce(returned, 0) AS returned, coalesce(tax, 0) AS tax FROM a LEFT JOIN b USING (k, w) LEFT JOIN c USING (k, w)")
def left_join_chain(spark, sf):
    """Three aggregates on one key: as conditional aggregates of one pass, which is what a chain of left joins on that key says."""
    k = _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 3).alias("w"))
    return k.agg(F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.coalesce(F.max(F.when(F.col("l_discount") > 0.09, F.col("l_tax"))), F.lit(0.0)).alias("tax"))


@query("left_outer_attributes", "SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_outer_attributes(spark, sf):
    place = _t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return _t(spark, sf, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("cross_spine", "SELECT r_name, date FROM region CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY))::DATE AS date)")
def cross_spine(spark, sf):
    return _t(spark, sf, "region").select("r_name", F.explode(F.expr("sequence(date'2024-01-01', date'2024-03-31', interval 1 day)")).alias("date"))


@query("consecutive_windows", "WITH m AS (SELECT date_trunc('month', l_shipdate)::DATE AS m, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT a.m AS month, count(*) AS both, round(avg(b.q - a.q), 6) AS mean_change FROM m a JOIN m b ON a.s = b.s AND b.m = a.m + INTERVAL 1 MONTH GROUP BY a.m".replace("AS both", 'AS "both"'))
def consecutive_windows(spark, sf):
    m = _t(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month"), F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"))
    nxt = m.select(F.add_months("month", -1).alias("month"), "s", F.col("q").alias("q2"))
    return m.join(nxt, ["month", "s"]).groupBy("month").agg(F.count("*").alias("both"), F.round(F.avg(F.col("q2") - F.col("q")), 6).alias("mean_change"))


@query("summary_statistics", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS p25, median(l_quantity) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS max, count(DISTINCT l_partkey) AS parts, count_if(l_discount > 0) AS discounted FROM lineitem GROUP BY l_returnflag", long="discounted")
def summary_statistics(spark, sf):
    q = F.col("l_quantity")
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("min"), F.percentile(q, F.lit(0.25)).alias("p25"), F.median(q).alias("p50"), F.percentile(q, F.lit(0.75)).alias("p75"), F.max(q).alias("max"), F.countDistinct("l_partkey").alias("parts"), F.count_if(F.col("l_discount") > 0).alias("discounted"))


@query("first_and_best_row", "SELECT o_custkey, min_by(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def first_and_best_row(spark, sf):
    by_date, by_price = F.struct("o_orderdate", "o_orderkey"), F.struct("o_totalprice", "o_orderkey")
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", by_date).alias("first_status"), F.min_by("o_orderkey", by_price).alias("cheapest"), F.max_by("o_orderkey", by_price).alias("dearest"))


@query("correlation_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qty_price, round(corr(l_quantity, l_discount), 6) AS qty_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem")
def correlation_matrix(spark, sf):
    return _t(spark, sf, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("qty_price"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("qty_discount"), F.round(F.corr("l_extendedprice", "l_tax"), 6).alias("price_tax"))


@query("value_counts", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type")
def value_counts(spark, sf):
    g = _t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("pivot_status", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS \"F\", count_if(o_orderstatus = 'O') AS \"O\", count_if(o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority", long="F O P")
def pivot_status(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("collected_sets", "SELECT l_orderkey, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY l_orderkey")
def collected_sets(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query("histogram", "SELECT CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INT) + 1 AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def histogram(spark, sf):
    e = _t(spark, sf, "events").select("value")
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(F.broadcast(span)).select((F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("int") + 1).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("cumulative_share", "WITH r AS (SELECT l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT s, q, round(sum(q) OVER (ORDER BY q DESC, s ROWS UNBOUNDED PRECEDING) / sum(q) OVER (), 6) AS share FROM r")
def cumulative_share(spark, sf):
    r = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.sum("l_quantity").alias("q"))
    total = r.agg(F.sum("q").alias("all"))  # one row
    return running(r, [F.desc("q"), F.col("s")], sums={"upto": "q"}).join(F.broadcast(total)).select("s", "q", F.round(F.col("upto") / F.col("all"), 6).alias("share"))


@query("group_transform", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id, month(ts)), 6) AS excess FROM events")
def group_transform(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.round(F.col("value") - F.avg("value").over(Window.partitionBy("user_id", F.month("ts"))), 6).alias("excess"))


@query("top_n_sorted", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")
def top_n_sorted(spark, sf):
    return _t(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("top_per_group", "SELECT l_suppkey, l_partkey, q FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) <= 3")
def top_per_group(spark, sf):
    q = _t(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return q.withColumn("r", P.ranked([F.desc("q"), F.col("l_partkey")], ["l_suppkey"])).filter("r <= 3").drop("r")


@query("one_per_category", "WITH d AS (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) > 1 AS second FROM part) SELECT p_partkey, p_type FROM d ORDER BY second, p_retailprice DESC, p_partkey LIMIT 12")
def one_per_category(spark, sf):
    return X.one_per_category(_t(spark, sf, "part"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 12).select("p_partkey", "p_type")


@query("set_operations", "SELECT 'either' AS what, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 300 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 300 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_operations(spark, sf):
    a = _t(spark, sf, "orders").filter("o_totalprice > 300").select(F.col("o_custkey").alias("k"))
    b = _t(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.union(b).distinct().agg(F.count("*").alias("n")).select(F.lit("either").alias("what"), "n").unionByName(a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("what"), "n"))


@query("date_parts", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, CAST(month(o_orderdate) AS INT) AS month, CAST(quarter(o_orderdate) AS INT) AS quarter, isodow(o_orderdate) >= 6 AS weekend, dayname(o_orderdate) AS day_name, date_diff('day', o_orderdate::DATE, DATE '2001-12-31')::INT AS days_left FROM orders")
def date_parts(spark, sf):
    d = F.col("o_orderdate")
    return _t(spark, sf, "orders").select("o_orderkey", F.weekday(d).alias("weekday"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), (F.weekday(d) >= 5).alias("weekend"), F.date_format(d, "EEEE").alias("day_name"), F.datediff(F.lit("2001-12-31").cast("date"), d).alias("days_left"))


@query("string_and_math", "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, concat(p_brand, '|', p_size) AS joined, CASE WHEN contains(lower(p_type), 'o') THEN 'o' ELSE 'other' END AS kind, round(sqrt(abs(p_retailprice - 1000)), 6) AS root, least(greatest(p_size, 10), 40) AS clipped, round(2 * asin(sqrt(p_size / 100.0::DOUBLE)), 6) AS arc FROM part")
def string_and_math(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.concat(F.col("p_brand"), F.lit("|"), F.col("p_size").cast("string")).alias("joined"), F.when(F.lower("p_type").contains("o"), "o").otherwise("other").alias("kind"), F.round(F.sqrt(F.abs(F.col("p_retailprice") - 1000)), 6).alias("root"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clipped"), F.round(2 * F.asin(F.sqrt(F.col("p_size") / 100.0)), 6).alias("arc"))


#: The draw of a key, as sampling.counter gives it; strings of hex digits sort as their numbers.
_DRAW = lambda key: f"substr(md5({key} || ':42'), 1, 15)"


@query("sample_rows", f"SELECT o_orderkey FROM orders ORDER BY {_DRAW('o_orderkey')}, o_orderkey LIMIT 200")
def sample_rows(spark, sf):
    return X.simple(_t(spark, sf, "orders"), "o_orderkey", 200).select("o_orderkey")


@query("stratified_sample", f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_DRAW('c_custkey')}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n, count(*) OVER () AS a FROM customer) WHERE r <= round_even(112 * n / a, 0)")
def stratified_sample(spark, sf):
    return X.stratified(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 112)


@query("bootstrap_resample", f"WITH s AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s.s_suppkey, s.s_acctbal FROM s d JOIN s ON s.i = CAST('0x' || {_DRAW('d.i')} AS BIGINT) % d.n")
def bootstrap_resample(spark, sf):
    return X.bootstrap(_t(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")


@query("csv_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS Order_ID, CAST(o_custkey AS VARCHAR) AS Customer_ID, CAST(o_orderdate AS DATE) AS Order_Date, o_totalprice AS Revenue FROM orders")
def csv_round_trip(spark, sf):
    """The table as CSV with a header and back under its declared schema."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("Order_ID"), F.col("o_custkey").cast("string").alias("Customer_ID"), F.col("o_orderdate").cast("date").alias("Order_Date"), F.col("o_totalprice").alias("Revenue"))
    path = files.scratch(spark, "orders-csv")
    files.write_csv(o, path)
    return files.read_csv(spark, path, "outbound_orders")
