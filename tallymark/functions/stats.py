"""Interval and test statistics as column expressions over counts."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two-sided 95 % point of the normal distribution; fixed by the rules for intervals.
Z95 = 1.959963984540054


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """The score interval of k of n, within 0 and 1; null without trials."""
    k, n = _c(k), _c(n)
    p = k / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def two_proportion_z(k1: Column | str, n1: Column | str, k2: Column | str, n2: Column | str) -> Column:
    """Pooled z of the second share less the first; 0 if there is no spread, null if an arm is empty."""
    k1, n1, k2, n2 = map(_c, (k1, n1, k2, n2))
    pooled = (k1 + k2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0), F.when(error > 0, (k2 / n2 - k1 / n1) / error).otherwise(0.0))


#: Coefficients of the rational approximation of erfc with a relative error below 1.2e-7 (Numerical Recipes), from the constant on.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column | str) -> Column:
    """P(|N(0,1)| > |z|) to six digits or more, as an expression: Spark has no error function."""
    x = F.abs(_c(z)) / 2**0.5
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + power))


def newcombe(k1: Column | str, n1: Column | str, k2: Column | str, n2: Column | str) -> tuple[Column, Column]:
    """Interval of the second share less the first from two score intervals, within -1 and 1."""
    k1, n1, k2, n2 = map(_c, (k1, n1, k2, n2))
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = k1 / n1, k2 / n2
    low = p2 - p1 - F.sqrt((p2 - l2) * (p2 - l2) + (u1 - p1) * (u1 - p1))
    high = p2 - p1 + F.sqrt((u2 - p2) * (u2 - p2) + (p1 - l1) * (p1 - l1))
    some = (n1 > 0) & (n2 > 0)
    return F.when(some, F.greatest(F.lit(-1.0), low)), F.when(some, F.least(F.lit(1.0), high))


def required_n(p1: Column | str, p2: Column | str, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Sample per arm that shows the difference of two shares, by the sum of their variances; null if they are equal."""
    p1, p2 = _c(p1), _c(p2)
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    return F.when(p1 != p2, F.ceil((za + zb) ** 2 * (p1 * (1 - p1) + p2 * (1 - p2)) / ((p2 - p1) * (p2 - p1))))


def critical_z(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)
