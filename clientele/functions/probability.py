"""Normal distribution as column expressions (Spark has no erf)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

# The published polynomial 7.1.26 of Abramowitz and Stegun for erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF, absolute error below 7.5e-8."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def normal_quantile(p: float) -> float:
    """Critical value for a test parameter (a constant, not a per-row value)."""
    return NormalDist().inv_cdf(p)
