"""Tail areas and quantiles of the usual distributions, for scalars and single-row results (no SciPy here)."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def z_of(p: float) -> float:
    return NORMAL.inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def incomplete_gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * math.exp(-x + s * math.log(x) - math.lgamma(s))


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return incomplete_gamma_upper(df / 2, x / 2)


def hypergeometric_upper(k: int, n: int, a: int, b: int) -> float:
    """P(overlap >= k) of random sets of sizes a and b among n."""
    lg = math.lgamma
    choose = lambda x, y: lg(x + 1) - lg(y + 1) - lg(x - y + 1)
    total = choose(n, b)
    return min(1.0, sum(math.exp(choose(a, i) + choose(n - a, b - i) - total) for i in range(max(k, a + b - n, 0), min(a, b) + 1)))


def cohen_h(p1: float, p2: float) -> float:
    return 2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2))


def n_per_arm(p1: float, p2: float, alpha: float = 0.05, power: float = 0.80) -> float:
    return 2 * ((z_of(1 - alpha / 2) + z_of(power)) / cohen_h(p1, p2)) ** 2


def detectable(p: float, n: float, alpha: float = 0.05, power: float = 0.80, least: float = 0.001) -> float:
    h = (z_of(1 - alpha / 2) + z_of(power)) * math.sqrt(2 / n)
    return max(least, math.sin(math.asin(math.sqrt(p)) + h / 2) ** 2 - p)


def power_two_sided(h: float, n: float, alpha: float = 0.05) -> float:
    z, s = z_of(1 - alpha / 2), abs(h) * math.sqrt(n / 2)
    return NORMAL.cdf(s - z) + NORMAL.cdf(-s - z)
