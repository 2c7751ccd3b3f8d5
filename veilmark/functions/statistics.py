"""Statistics that hold under ANSI mode and in the edge cases of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation by covariance; 0 for fewer than two pairs or a constant side, where ``corr`` would raise."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))), F.lit(0.0))


def sample_sd(x: Column) -> Column:
    """Sample standard deviation, 0 for one value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def exact_percentile(x: Column, q: float) -> Column:
    """With linear interpolation."""
    return F.percentile(x, F.lit(q))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """From counts; two empty sets have 0."""
    return F.coalesce(F.try_divide(common.cast("double"), left + right - common), F.lit(0.0))
