"""Tails of distributions that Spark lacks, in numpy."""

from __future__ import annotations

from math import erf, exp, lgamma, log, log1p, sqrt
from statistics import NormalDist

EULER = 0.5772156649015329


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + erf(x / sqrt(2.0)))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def student_p(t: float | None, df: float | None) -> float | None:
    """The two-sided tail of Student's t; None where it is not defined."""
    if t is None or df is None or t != t or df < 1:
        return None
    return beta_tail(df / 2.0, 0.5, df / (df + t * t))
