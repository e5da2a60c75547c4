"""Experiments: conversion, power, assignment, tests, guardrail, decision. Scalars come from one-row frames; laws from functions.tails."""

from __future__ import annotations

import datetime
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stockyard.functions import tails
from stockyard.operators.sampling import counter


def conversion(sales: DataFrame, customers: DataFrame, now: tuple[datetime.date, datetime.date], before: tuple[datetime.date, datetime.date], quarters: float = 3.0, drop: float = -0.20) -> DataFrame:
    """customer, orders_now, rate_before, change, converted for every row of customers; who never ordered counts as zero. One pass over sales."""
    c = sales.groupBy("customer").agg(F.count_if(F.col("date").between(*now)).alias("orders_now"), F.count_if(F.col("date").between(*before)).alias("b"))
    j = customers.select("customer").join(c, "customer", "left").fillna(0, ["orders_now", "b"])
    j = j.withColumn("rate_before", F.col("b") / quarters).withColumn("change", (F.col("orders_now") - F.col("rate_before")) / (F.col("rate_before") + 1e-9))
    return j.select("customer", "orders_now", "rate_before", "change", (F.col("change") >= drop).cast("int").alias("converted"))


def power_analysis(p: float, available: int, mde: float = 0.05, alpha: float = 0.05, power: float = 0.80) -> dict:
    p2 = min(p + mde, 0.999)
    need = math.ceil(tails.n_per_arm(p, p2, alpha, power))
    used = min(need, available // 2)
    return {"baseline_rate": p, "mde": mde, "effect": tails.cohen_h(p, p2), "required_n": need, "used_n": used, "available": available, "feasible": available >= 2 * need, "detectable_mde": tails.detectable(p, max(used, 1), alpha, power), "alpha": alpha, "power": power}


def scenarios(mde: Column, at_risk: Column, aov: Column, contact: float = 8.0) -> Column:
    """array of struct(scenario, lift, orders, revenue, cost, net, roi_pct): half, one and two times the detectable lift."""
    cost = at_risk * contact
    rows = []
    for name, k in (("Pessimistic", 0.5), ("Realistic", 1.0), ("Optimistic", 2.0)):
        rev = at_risk * mde * k * aov
        rows.append(F.struct(F.lit(name).alias("scenario"), (mde * k).alias("lift"), (at_risk * mde * k).alias("orders"), rev.alias("revenue"), cost.alias("cost"), (rev - cost).alias("net"), F.when(cost > 0, 100 * (rev - cost) / cost).otherwise(0.0).alias("roi_pct")))
    return F.array(*rows)


def assign(customers: DataFrame, stratum: str, per_arm: int, seed: int = 42) -> DataFrame:
    """customer, stratum, arm: within each stratum, by hash order, the first rounded share (half to even) to Treatment, as many to Control; at
    most per_arm an arm. Depends on keys and seed only, not on partitions."""
    total = customers.agg(F.count("*").alias("_all"))
    w = Window.partitionBy(stratum)
    c = customers.join(F.broadcast(total)).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(counter("customer", seed), "customer")))
    treat = F.least(F.bround(F.col("_n") * per_arm / F.col("_all")), F.col("_n"))
    control = F.least(treat, F.col("_n") - treat)
    c = c.withColumn("arm", F.when(F.col("_r") <= treat, "Treatment").when(F.col("_r") <= treat + control, "Control")).filter(F.col("arm").isNotNull())
    return c.withColumn("_k", F.row_number().over(Window.partitionBy("arm").orderBy(stratum, "_r"))).filter(F.col("_k") <= per_arm).select("customer", stratum, "arm")


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """struct(p1, p2, diff, z, low, high): pooled z, unpooled 95% interval."""
    p1, p2, p = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    se = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    z = (p1 - p2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.struct(p1.alias("p1"), p2.alias("p2"), (p1 - p2).alias("diff"), z.alias("z"), (p1 - p2 - 1.96 * se).alias("low"), (p1 - p2 + 1.96 * se).alias("high"))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(tails.normal_two_sided)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([tails.t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def post_hoc_power(p1: pd.Series, p2: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([tails.power_two_sided(tails.cohen_h(a, b), c) if abs(tails.cohen_h(a, b)) > 1e-6 else 0.0 for a, b, c in zip(p1, p2, n, strict=True)])


def welch(df: DataFrame, arm: str, value: str, a: str, b: str, most_drop: float = -0.05) -> DataFrame:
    """One row: means, change of a against b, Welch's t and df, and whether the guardrail holds."""
    g = df.groupBy().pivot(arm, [a, b]).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    ma, mb = F.col(f"{a}_m"), F.col(f"{b}_m")
    va, vb = F.col(f"{a}_v") / F.col(f"{a}_n"), F.col(f"{b}_v") / F.col(f"{b}_n")
    dof = (va + vb) ** 2 / (va**2 / (F.col(f"{a}_n") - 1) + vb**2 / (F.col(f"{b}_n") - 1))
    change = (ma - mb) / mb
    return g.select(ma.alias("mean_a"), mb.alias("mean_b"), change.alias("change"), ((ma - mb) / F.sqrt(va + vb)).alias("t"), dof.alias("df"), (change >= most_drop).alias("guardrail"))


def verdict(significant: Column, roi: Column, guardrail: Column, lift: Column, break_even: Column) -> Column:
    return F.when(significant & (roi > 0) & guardrail, "SCALE").when(significant & (roi <= 0), "NO_SCALE_ROI").when(~significant & (lift > break_even), "FOLLOW_UP").otherwise("NO_GO")


def simulated_outcomes(n_treatment: int, n_control: int, base: float, lift: float, seed: int = 42) -> tuple[int, int]:
    """Conversions of both arms, for demonstrations only: treatment at base + lift + N(0, .01), clipped."""
    import numpy as np

    rate = float(np.clip(base + lift + np.random.default_rng(seed).normal(0, 0.01), 0.01, 0.999))
    return round(rate * n_treatment), round(base * n_control)
