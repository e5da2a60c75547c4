"""Daily indicators, control-chart rules and CUSUM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("pick_accuracy", "error_rate", "mean_duration")


def daily_kpis(tasks: DataFrame) -> DataFrame:
    """A row per warehouse and day; a rate over no task is null."""
    pick = F.col("task_type") == "Pick"
    return tasks.groupBy("warehouse", "date").agg(
        F.count("*").alias("volume"),
        F.avg(F.when(pick, (1 - F.col("error")).cast("double"))).alias("pick_accuracy"),
        F.sum("error").alias("errors"),
        (F.sum("error") / F.count("*")).alias("error_rate"),
        (F.sum("duration").cast("double") / F.count("duration")).alias("mean_duration"),
        (F.sum(F.when(pick, F.col("duration"))).cast("double") / F.nullif(F.count_if(pick & F.col("duration").isNotNull()), F.lit(0))).alias("mean_pick_duration"),
        F.countDistinct("operator").alias("operators"),
    )


def operator_kpis(tasks: DataFrame, least: int = 5) -> DataFrame:
    return tasks.groupBy("operator", "warehouse", "date").agg(F.count("*").alias("tasks"), (F.sum("error") / F.count("*")).alias("error_rate"), (F.sum("duration").cast("double") / F.count("*")).alias("mean_duration")).filter(F.col("tasks") >= least)


def long_metrics(kpis: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """warehouse, date, metric, x."""
    return kpis.select("warehouse", "date", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m")).select("warehouse", "date", "m.*")


_SERIES = ("warehouse", "metric")


def _over(lo: int, hi: int = 0):
    return Window.partitionBy(*_SERIES).orderBy("date").rowsBetween(lo, hi)


def baseline(long: DataFrame, rows: int = 30, least: int = 10) -> DataFrame:
    """mu and sd of the last rows, this one included; null below `least` values."""
    w = _over(1 - rows)
    enough = F.count("x").over(w) >= least
    return long.withColumns({"mu": F.when(enough, F.avg("x").over(w)), "sd": F.when(enough, F.stddev_samp("x").over(w))})


def _n(flag: Column, lo: int) -> Column:
    return F.sum(flag.cast("int")).over(_over(lo))


def run_rules(based: DataFrame) -> DataFrame:
    """rule1 .. rule4 on rows with mu and sd.

    1: beyond three sd. 2: two of three beyond two sd on one side, with three baselines. 3: eight in a row above the mean, or eight not
    above it. 4: six points steadily rising or falling.
    """
    x, mu, sd = F.col("x"), F.col("mu"), F.col("sd")
    no = lambda c: F.coalesce(c, F.lit(False))
    first = Window.partitionBy(*_SERIES).orderBy("date")
    d = based.withColumns({"_hi": no(x > mu + 2 * sd), "_lo": no(x < mu - 2 * sd), "_up": no(x > mu), "_based": mu.isNotNull() & sd.isNotNull(), "_step": F.signum(x - F.lag("x").over(first)), "_i": F.row_number().over(first)})
    whole = lambda k: _n(F.col("_based"), 1 - k) == k
    rule3 = no(F.when(mu.isNotNull() & (F.col("_i") >= 8), (_n(F.col("_up"), -7) == 8) | ((_n(F.col("_up"), -7) == 0) & (F.count("mu").over(_over(-7)) == 8))))
    rule4 = no((F.col("_i") >= 6) & (F.abs(F.sum("_step").over(_over(-4))) == 5) & (F.count("_step").over(_over(-4)) == 5))
    return d.withColumns({"rule1": no((x > mu + 3 * sd) | (x < mu - 3 * sd)), "rule2": no(whole(3) & ((_n(F.col("_hi"), -2) >= 2) | (_n(F.col("_lo"), -2) >= 2))), "rule3": rule3, "rule4": rule4}).drop("_hi", "_lo", "_up", "_based", "_step", "_i")


def cusum(based: DataFrame, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """warehouse, metric, date, c_plus, c_minus, alarm: two-sided sums of standardised excess, back to zero after an alarm.

    The first point only starts the sums; a null x carries them on; null mu or sd fall back to the series' own; sd 0 counts as 1e-9.
    A fold over each series' sorted points: the reset rules out plain windows, so one series is one value.
    """
    w = Window.partitionBy(*_SERIES)
    d = based.withColumns({"mu": F.coalesce("mu", F.avg("x").over(w)), "sd": F.coalesce("sd", F.stddev_samp("x").over(w))})
    d = d.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9))
    s = d.groupBy(*_SERIES).agg(F.sort_array(F.collect_list(F.struct("date", "x", "mu", "sd"))).alias("ps"))
    point = "array<struct<date:date,c_plus:double,c_minus:double,alarm:boolean>>"
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("m"), F.array().cast(point).alias("out"), F.lit(0).alias("i"))

    def step(a, t):
        z = (t["x"] - t["mu"]) / t["sd"]
        skip = t["x"].isNull() | (a["i"] == 0)
        p, m = F.when(skip, a["p"]).otherwise(F.greatest(F.lit(0.0), a["p"] + z - k)), F.when(skip, a["m"]).otherwise(F.greatest(F.lit(0.0), a["m"] - z - k))
        alarm = (p > h) | (m > h)
        p, m = F.when(alarm, 0.0).otherwise(p), F.when(alarm, 0.0).otherwise(m)
        return F.struct(p.alias("p"), m.alias("m"), F.array_append(a["out"], F.struct(t["date"].alias("date"), p.alias("c_plus"), m.alias("c_minus"), alarm.alias("alarm"))).alias("out"), (a["i"] + 1).alias("i"))

    return s.select(*_SERIES, F.explode(F.aggregate("ps", zero, step, lambda a: a["out"])).alias("o")).select(*_SERIES, "o.*")


def anomalies(ruled: DataFrame, sums: DataFrame) -> DataFrame:
    """warehouse, date, metric, rule: every flag once."""
    long = ruled.select("warehouse", "date", "metric", F.explode(F.array(*[F.when(F.col(r), r) for r in ("rule1", "rule2", "rule3", "rule4")])).alias("rule")).filter(F.col("rule").isNotNull())
    return long.unionByName(sums.filter("alarm").select("warehouse", "date", "metric", F.lit("cusum").alias("rule"))).distinct()


def sigma_sensitivity(based: DataFrame, sigmas: tuple[float, ...] = (2.0, 2.5, 3.0)) -> DataFrame:
    """warehouse, sigma, days with any metric beyond."""
    s = based.filter(F.col("sd").isNotNull()).select("warehouse", "date", (F.abs(F.col("x") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"))
    day = s.groupBy("warehouse", "date").agg(F.max("z").alias("z")).select("warehouse", "z", F.explode(F.array(*map(F.lit, sigmas))).alias("sigma"))
    return day.groupBy("warehouse", "sigma").agg(F.count_if(F.col("z") > F.col("sigma")).alias("days"))
