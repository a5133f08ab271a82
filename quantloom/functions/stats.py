"""Statistics that Spark lacks or defines otherwise, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from quantloom.functions.windows import col

#: Coefficients of the rational approximation of the normal quantile, for the middle and for the tails.
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
PPF_LOW = 0.02425
#: Coefficients of the rational approximation of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """A polynomial by nested multiplication, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column | str) -> Column:
    """Standard normal distribution function, to 1.5e-7."""
    z = F.abs(col(x)) / 2**0.5
    t = 1 / (1 + ERF_P * z)
    tail = polynomial(t, ERF_A[::-1]) * t * F.exp(-z * z) / 2
    return F.when(col(x) >= 0, 1 - tail).otherwise(tail)


def normal_ppf(p: Column | str) -> Column:
    """Standard normal quantile for 0 < p < 1, to 1e-9."""
    p = col(p)
    q = p - 0.5
    middle = polynomial(q * q, PPF_A) * q / polynomial(q * q, (*PPF_B, 1.0))
    low = F.sqrt(-2 * F.log(F.least(p, F.lit(0.5))))
    high = F.sqrt(-2 * F.log(F.least(1 - p, F.lit(0.5))))
    tail = lambda r: polynomial(r, PPF_C) / polynomial(r, (*PPF_D, 1.0))
    return F.when(p < PPF_LOW, tail(low)).when(p > 1 - PPF_LOW, -tail(high)).otherwise(middle)


def both(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """x and y, each NULL where the other is."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the complete pairs, NULL where it is undefined."""
    x, y = both(x, y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(over) for p in parts] if over else parts
    return F.try_divide(cov, sx * sy)


def average_rank(x: Column | str, over: WindowSpec, ties: WindowSpec) -> Column:
    """Rank within ``over`` (ordered by x), ties getting the mean of their ranks; ``ties`` is ``over`` partitioned by x too."""
    return F.rank().over(over) + (F.count(col(x)).over(ties) - 1) / 2.0


def skew_sample(x: Column | str) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(col(x))
    return F.when(n >= 3, F.skewness(col(x)) * F.sqrt(n * (n - 1.0)) / F.greatest(n - 2, F.lit(1)))


def excess_kurtosis_sample(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(col(x))
    below = F.greatest((n - 2) * (n - 3), F.lit(1))
    return F.when(n >= 4, ((n + 1) * F.kurtosis(col(x)) + 6) * (n - 1) / below)


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))
