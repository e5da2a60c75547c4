"""Forecasts by series, their accuracy, and series diagnostics, over dense daily rows (k, date, q)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions import tails
from stockyard.operators.arima import recursive


def split(dense: DataFrame, test_days: int = 92) -> DataFrame:
    """With t (days from the first), n (all days) and train (all but the last test_days)."""
    span = dense.agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    d = dense.join(F.broadcast(span))
    return d.select("k", "date", "q", F.datediff("date", "d0").alias("t"), (F.datediff("d1", "d0") + 1).alias("n"), (F.datediff("d1", "date") >= test_days).alias("train"))


def activity(parts: DataFrame, all_share: float = 0.10, train_share: float = 0.30) -> DataFrame:
    """k, share, train_share, active: days with demand over all days and over train days."""
    g = parts.groupBy("k").agg((F.count_if(F.col("q") > 0) / F.count("*")).alias("share"), (F.count_if(F.expr("train and q > 0")) / F.count_if("train")).alias("train_share"))
    return g.withColumn("active", (F.col("share") > all_share) & (F.col("train_share") >= train_share))


def patterns(parts: DataFrame, zero: float = 0.40) -> DataFrame:
    """Both definitions: by train zeros over train days (> zero), and by train demand days over all days (zeros >= zero)."""
    g = parts.groupBy("k").agg((F.count_if(F.expr("train and q = 0")) / F.count_if("train")).alias("a"), (1 - F.count_if(F.expr("train and q > 0")) / F.count("*")).alias("b"))
    label = lambda c: F.when(c, "intermittent").otherwise("regular")
    return g.select("k", label(F.col("a") > zero).alias("pattern"), label(F.col("b") >= zero).alias("pattern_all_days"))


def naive(parts: DataFrame) -> DataFrame:
    last = parts.filter("train").groupBy("k").agg(F.max_by("q", "date").alias("forecast"))
    return _test(parts).join(last, "k").select("k", "date", "q", F.lit("Naive").alias("model"), "forecast")


def _test(parts: DataFrame) -> DataFrame:
    return parts.filter("not train")


def seasonal_naive(parts: DataFrame, period: int = 7, test_days: int = 92) -> DataFrame:
    """The last train week, repeated."""
    back = F.col("n") - test_days - F.col("t")
    week = parts.filter("train").filter(back <= period).select("k", (period - back).alias("slot"), F.col("q").alias("forecast"))
    slot = (F.col("t") - (F.col("n") - test_days)) % period
    return _test(parts).withColumn("slot", slot).join(week, ["k", "slot"]).select("k", "date", "q", F.lit("SeasonalNaive").alias("model"), "forecast")


def croston(parts: DataFrame, alpha: float = 0.1) -> DataFrame:
    """k, size, interval, croston, sba, in closed form over demand days: a sum of powers, no fold.

    Size and interval start at the first demand and at 1; each later demand day updates both by alpha, the interval with its gap.
    """
    w = Window.partitionBy("k").orderBy("t")
    d = parts.filter("train and q > 0").withColumns({"i": F.row_number().over(w) - 1, "gap": F.col("t") - F.lag("t").over(w), "m": F.count("*").over(Window.partitionBy("k")) - 1})
    weight = F.when(F.col("i") == 0, F.pow(F.lit(1 - alpha), "m")).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("m") - F.col("i")))
    g = d.groupBy("k").agg(F.sum(weight * F.col("q")).alias("size"), F.sum(weight * F.when(F.col("i") == 0, 1).otherwise(F.col("gap"))).alias("interval"))
    keys = parts.select("k").distinct().join(g, "k", "left")
    rate = F.coalesce(F.col("size") / F.col("interval"), F.lit(0.0))
    return keys.select("k", "size", "interval", rate.alias("croston"), (rate * (1 - alpha / 2)).alias("sba"))


def croston_forecasts(parts: DataFrame, alpha: float = 0.1) -> DataFrame:
    c = croston(parts, alpha).select("k", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(x).alias("forecast")) for m, x in (("Croston", "croston"), ("SBA", "sba"))])).alias("m")).select("k", "m.*")
    return _test(parts).join(c, "k").select("k", "date", "q", "model", "forecast")


def ses_level(qs: Column, alpha: Column, level0: Column) -> tuple[Column, Column]:
    """Final level and sum of squared one-step errors of simple exponential smoothing over an array."""
    z = F.struct(level0.cast("double").alias("l"), F.lit(0.0).alias("e"))
    end = F.aggregate(qs, z, lambda s, q: F.struct((s["l"] + alpha * (q - s["l"])).alias("l"), (s["e"] + (q - s["l"]) * (q - s["l"])).alias("e")))
    return end["l"], end["e"]


def ses(parts: DataFrame, grid: int = 19) -> DataFrame:
    """k, alpha, level: alpha by least squared error on a grid, the start at the mean of the first ten days. A series is one value here."""
    s = parts.filter("train").groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "q"))), lambda x: x["q"]).alias("qs"))
    head = F.slice("qs", 1, 10)
    s = s.withColumn("l0", F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head))
    each = s.withColumn("alpha", F.explode(F.array(*[F.lit((i + 1) / (grid + 1)) for i in range(grid)])))
    level, sse = ses_level(F.col("qs"), F.col("alpha"), F.col("l0"))
    return each.select("k", "alpha", level.alias("level"), sse.alias("sse")).groupBy("k").agg(F.min_by(F.struct("alpha", "level"), F.struct("sse", "alpha")).alias("b")).select("k", "b.alpha", "b.level")


def ses_with_best_start(y: np.ndarray, alpha: float) -> tuple[float, float, float, float]:
    """(sse, alpha, start, level) of simple exponential smoothing whose start has the least squared error for this alpha.

    Errors follow e[t] = y[t] - y[t-1] + (1 - alpha) e[t-1], and moving the start by x moves error t by -x (1 - alpha)^t: a regression.
    """
    about = float(y.mean())
    x = np.zeros((2, len(y)))
    x[0], x[1, 0] = np.diff(y, prepend=about), 1.0
    e, g = recursive(x, np.array([alpha - 1.0]))
    by = float(e @ g / (g @ g))
    e = e - by * g
    return float(e @ e), alpha, about + by, float(y[-1] - (1 - alpha) * e[-1])


def ses_likelihood(parts: DataFrame, rounds: int = 6) -> DataFrame:
    """k, alpha, start, level, sse, aic: the most likelihood over alpha in [0, 1] and the start (Gaussian errors: the least squared error).

    Twenty-one levels from 0 to 1, then `rounds` times the neighbourhood of the best, ten times finer, so alpha is exact to 0.05 / 10^rounds; the best so far is among
    each round's levels. One series a call (days, not events); null demand counts as none, a series without train days has no row.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["q"].fillna(0.0).to_numpy(float)
        best = min(ses_with_best_start(y, i / 20) for i in range(21))
        for r in range(1, rounds + 1):
            best = min(ses_with_best_start(y, min(1.0, max(0.0, best[1] + i * 0.05 / 10**r))) for i in range(-10, 11))
        sse, alpha, start, level = best
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "alpha": [alpha], "start": [start], "level": [level], "sse": [sse], "aic": [len(y) * math.log(max(sse, 1e-300) / len(y)) + 4]})

    return parts.filter("train").select("k", "t", F.col("q").cast("double").alias("q")).groupBy("k").applyInPandas(fit, "k string, alpha double, start double, level double, sse double, aic double")


def ses_forecasts(parts: DataFrame) -> DataFrame:
    return _test(parts).join(ses(parts), "k").select("k", "date", "q", F.lit("SES").alias("model"), F.col("level").alias("forecast"))


def accuracy(forecasts: DataFrame) -> DataFrame:
    """k, model, mape (over actual > 0, null if none), rmse, mae, bias (forecast less actual)."""
    e = F.col("forecast") - F.col("q")
    return forecasts.groupBy("k", "model").agg(F.avg(F.when(F.col("q") > 0, F.abs(e) / F.col("q") * 100)).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def comparison(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """model, class, pattern (or 'all'), n, mean_mape, mean_rmse: two levels in one pass by grouping sets. classes: k, class, pattern."""
    j = scored.join(classes, "k")
    g = j.groupingSets([["model", "class", "pattern"], ["model", "class"]], "model", "class", "pattern").agg(F.countDistinct("k").alias("n"), F.avg("mape").alias("mean_mape"), F.avg("rmse").alias("mean_rmse"))
    return g.withColumn("pattern", F.coalesce("pattern", F.lit("all")))


def best_model(scored: DataFrame, by: list[str], value: str = "mean_mape") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value, "model")
    return scored.filter(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# Tests between models


def paired_t(scored: DataFrame, a: str, b: str, value: str = "mape") -> DataFrame:
    """One row: n, mean difference a - b, t, p."""
    d = scored.filter(F.col("model").isin(a, b)).groupBy("k").pivot("model", [a, b]).agg(F.first(value)).dropna().select((F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d"))
    g = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"))

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or m < 2 else tails.t_two_sided(x, m - 1) for x, m in zip(t, n, strict=True)], dtype=float)

    return g.withColumn("p", p("t", "n"))


def wilcoxon(scored: DataFrame, a: str, b: str, value: str = "mape") -> DataFrame:
    """One row: n (without zero differences), w (the smaller rank sum), p by the tie-corrected normal approximation."""
    d = scored.filter(F.col("model").isin(a, b)).groupBy("k").pivot("model", [a, b]).agg(F.first(value)).dropna().select((F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d")).filter("d <> 0")
    by = Window.orderBy(F.abs("d"))
    ties = F.count("*").over(Window.partitionBy(F.abs("d")))
    r = d.select("d", (F.rank().over(by) + (ties - 1) / 2).alias("r"), (ties * ties - 1).alias("tt"))
    g = r.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("down"), F.sum("tt").alias("tt"))
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("tt") / 48)
    g = g.select("n", F.least("up", "down").alias("w"), ((F.least("up", "down") - F.col("n") * (F.col("n") + 1) / 4) / sd).alias("z"))

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else tails.normal_two_sided(x) for x in z], dtype=float)

    return g.withColumn("p", p("z"))


# Diagnostics


def weekday_f(dense: DataFrame) -> DataFrame:
    """k, f, p: does the mean depend on the weekday? Between and within sums of squares from weekday sums."""
    g = dense.groupBy("k", F.weekday("date").alias("w")).agg(F.count("*").alias("c"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"))
    g = g.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("m"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    f = (between / (F.col("m") - 1)) / ((F.col("ss") - F.col("b")) / (F.col("n") - F.col("m")))

    @F.pandas_udf("double")
    def p(f: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([tails.f_upper(x, a - 1, b - a) for x, a, b in zip(f, m, n, strict=True)])

    return g.select("k", f.alias("f"), "m", "n").withColumn("p", p("f", "m", "n")).select("k", "f", "p")


def acf(dense: DataFrame, lags: int = 25) -> DataFrame:
    """k, lag, acf, band: autocovariances with denominator n, by windows over each series."""
    w = Window.partitionBy("k").orderBy("date")
    c = dense.withColumn("x", F.col("q") - F.avg("q").over(Window.partitionBy("k"))).withColumn("xs", F.array(*[F.lag("x", i).over(w) for i in range(lags + 1)]))
    e = c.select("k", "x", F.posexplode("xs").alias("lag", "y"))
    g = e.groupBy("k", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("c"), F.count("*").alias("n"))
    return g.select("k", "lag", (F.col("c") / F.max(F.when(F.col("lag") == 0, F.col("c"))).over(Window.partitionBy("k"))).alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def pacf(acfs: DataFrame) -> DataFrame:
    """k, lag, pacf by Durbin and Levinson's recursion on each series' autocorrelations."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy(float)
        out, phi = [1.0], np.zeros(0)
        for m in range(1, len(r)):
            num = r[m] - (phi * r[m - 1 : 0 : -1]).sum() if m > 1 else r[1]
            den = 1 - (phi * r[1:m]).sum() if m > 1 else 1.0
            last = num / den if den else 0.0
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "lag": range(len(r)), "pacf": out})

    return acfs.groupBy("k").applyInPandas(solve, "k string, lag int, pacf double")


def ljung_box(acfs: DataFrame, lags: int = 10) -> DataFrame:
    n = F.pow(1.96 / F.col("band"), 2)
    g = acfs.filter(F.col("lag").between(1, lags)).groupBy("k").agg(F.first(n).alias("n"), F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).alias("s"))

    @F.pandas_udf("double")
    def p(q: pd.Series) -> pd.Series:
        return q.map(lambda x: tails.chi2_upper(x, lags))

    return g.select("k", (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("q")).withColumn("p", p("q"))


def decompose(dense: DataFrame, period: int = 7) -> DataFrame:
    """k, date, q, trend, seasonal, residual: centred mean, carried on at both ends along the line through its nearest `period` values;
    weekday means of the rest, centred."""
    w = Window.partitionBy("k").orderBy("date")
    half = period // 2
    c = dense.select("k", "date", "q", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("k")).alias("n"), F.when(F.count("*").over(w.rowsBetween(-half, half)) == period, F.avg("q").over(w.rowsBetween(-half, half))).alias("trend"))
    front, back = F.when(F.col("i") <= half + period, F.col("trend")), F.when(F.col("i") > F.col("n") - half - period, F.col("trend"))
    lines = c.groupBy("k").agg(*[f(y, F.col("i")).alias(f"{side}_{name}") for side, y in (("f", front), ("b", back)) for name, f in (("s", F.regr_slope), ("i", F.regr_intercept))])
    at = lambda side: F.col(f"{side}_i") + F.col(f"{side}_s") * F.col("i")
    t = c.join(lines, "k").select("k", "date", "q", F.weekday("date").alias("w"), F.when(F.col("i") <= half, at("f")).when(F.col("i") > F.col("n") - half, at("b")).otherwise(F.col("trend")).alias("trend"))
    day = t.groupBy("k", "w").agg(F.avg(F.col("q") - F.col("trend")).alias("s"))
    day = day.withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy("k")))
    return t.join(day, ["k", "w"]).select("k", "date", "q", "trend", F.col("s").alias("seasonal"), (F.col("q") - F.col("trend") - F.col("s")).alias("residual"))


def _ols(x: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / max(len(y) - x.shape[1], 1)
    se = np.sqrt(np.diag(s2 * np.linalg.pinv(x.T @ x)))
    return beta, se, float(e @ e)


#: MacKinnon's response surface for a constant: coefficients of the normal quantile in tau, small and large tau, and their limits (fixed values).
_MACKINNON = {"small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368), "star": -1.61, "min": -18.83, "max": 2.74}


def mackinnon_p(tau: float) -> float:
    if tau > _MACKINNON["max"]:
        return 1.0
    if tau < _MACKINNON["min"]:
        return 0.0
    c = _MACKINNON["small"] if tau <= _MACKINNON["star"] else _MACKINNON["large"]
    return tails.NORMAL.cdf(sum(a * tau**i for i, a in enumerate(c)))


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """tau, p, lag of the augmented Dickey-Fuller test with a constant, the lag by least AIC."""
    n = len(y)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dy = np.diff(y)
    if most < 0 or np.ptp(y) == 0:
        return float("nan"), float("nan"), 0

    def design(lag: int, start: int):
        rows = np.arange(start, len(dy))
        return np.column_stack([y[rows], *[dy[rows - i] for i in range(1, lag + 1)], np.ones(len(rows))]), dy[rows]

    best = None
    for lag in range(most + 1):
        x, d = design(lag, most)
        _, _, sse = _ols(x, d)
        aic = len(d) * math.log(max(sse, 1e-300) / len(d)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lag)
    x, d = design(best[1], best[1])
    beta, se, _ = _ols(x, d)
    tau = float(beta[0] / se[0])
    return tau, mackinnon_p(tau), best[1]


def adf_by_key(parts: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tau, p, lag = adf(pdf.sort_values("t")["q"].to_numpy(float))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "tau": [tau], "p": [p], "lags": [lag], "d": [int(not p < 0.05)]})

    return parts.filter("train").groupBy("k").applyInPandas(run, "k string, tau double, p double, lags int, d int")


def qq_points(residuals: DataFrame, column: str = "residual") -> DataFrame:
    """k, x (normal quantile), y (ordered value)."""
    w = Window.partitionBy("k").orderBy(column)
    r = residuals.filter(F.col(column).isNotNull()).select("k", F.col(column).alias("y"), ((F.row_number().over(w) - 0.5) / F.count("*").over(Window.partitionBy("k"))).alias("u"))

    @F.pandas_udf("double")
    def x(u: pd.Series) -> pd.Series:
        return u.map(tails.z_of)

    return r.select("k", x("u").alias("x"), "y")
