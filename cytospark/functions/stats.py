"""Column functions of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The square of the normal quantile of the confidence intervals, and the quantile (fixed values).
Z_SQUARED, Z = 10.8275661707, 3.2905267315


def share(m: Column, u: Column) -> Column:
    """m / (m + u); null at no depth."""
    return m / F.nullif(m + u, F.lit(0))


def percentage(m: Column, u: Column) -> Column:
    """The whole percentage, rounded down; 0 at no depth. Exact integers, an overflow is an error."""
    return F.when(m + u == 0, F.lit(0).cast("long")).otherwise(F.floor((m * 100 - F.pmod(m * 100, F.nullif(m + u, F.lit(0)))) / F.nullif(m + u, F.lit(0))).cast("long"))


def log_odds(m: Column, u: Column) -> Column:
    """ln(f) - ln(1 - f), infinite at the ends, null at no depth."""
    f = share(m, u)
    return F.when(m + u == 0, None).when(m == 0, F.lit(float("-inf"))).when(u == 0, F.lit(float("inf"))).otherwise(F.log(f) - F.log1p(-f))


def agresti_coull(m: Column, u: Column) -> tuple[Column, Column]:
    """The lower and upper end of the interval, within 0 and 1."""
    n = m + u + Z_SQUARED
    p = (m + 0.5 * Z_SQUARED) / n
    radius = Z * F.sqrt(p / n * (1 - p))
    return F.greatest(p - radius, F.lit(0.0)), F.least(p + radius, F.lit(1.0))
