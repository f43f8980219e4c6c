"""Distribution functions for single numbers on the driver: tails and quantiles of the normal, chi-square, t and F distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _N.inv_cdf(min(max(p, 1e-300), 1 - 1e-16))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by the series below a + 1 and the continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """By bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def kolmogorov_tail(x: float) -> float:
    """Of the limiting distribution of the scaled greatest gap."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
