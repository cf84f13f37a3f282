"""Numbers: guarded logs, clipping, order statistics, normal distribution."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F


def log(c: Column) -> Column:
    """Natural logarithm, null where it has none."""
    return F.when(c > 0, F.ln(c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ordered_ends(low: Column, high: Column) -> tuple[Column, Column]:
    """The ends swapped where they cross."""
    crossed = low > high
    return F.when(crossed, high).otherwise(low), F.when(crossed, low).otherwise(high)


def pinball(y: Column, q: Column, alpha: float) -> Column:
    d = y - q
    return F.when(d >= 0, F.lit(alpha) * d).otherwise(F.lit(alpha - 1) * d)


def whole_days(c: Column) -> Column:
    """A usable day count: present, finite, not negative, whole."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0) & (c == F.floor(c)), F.lit(False))


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness of a column (null under three values)."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_excess_kurtosis(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 3, (n - 1) / (F.nullif(n - 2, F.lit(0)) * F.nullif(n - 3, F.lit(0))) * ((n + 1) * F.kurtosis(c) + 6))
