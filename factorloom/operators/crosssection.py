"""Operators across the tickers of a date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.functions import clip, safe_div


def rank(x: Column, *by: str) -> Column:
    """Percentile rank, ties averaged; NULL stays NULL and isn't counted."""
    by = by or ("date",)
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(0, 0))
    return F.when(x.isNotNull(), safe_div(F.rank().over(order) + (ties - 1) / 2, F.count(x).over(Window.partitionBy(*by))))


def scale(x: Column, k: float = 1.0, *by: str) -> Column:
    """Absolute values of a date add up to k; NULL for a date whose values are all 0."""
    return safe_div(x * F.lit(float(k)), F.sum(F.abs(x)).over(Window.partitionBy(*(by or ("date",)))))


def zscore_clip(x: Column, limit: float, *by: str) -> Column:
    """Population z-score within +-limit; 0 on a date without spread."""
    w = Window.partitionBy(*(by or ("date",)))
    spread = F.stddev_pop(x).over(w)
    return clip(F.when(spread > 0, (x - F.avg(x).over(w)) / spread).otherwise(F.when(x.isNotNull(), 0.0)), -limit, limit)


def demean(x: Column, *by: str) -> Column:
    return x - F.avg(x).over(Window.partitionBy(*by))


def residual(y: Column, x: Column, *by: str) -> Column:
    """What a straight line in x leaves of y, within each group of at least two complete pairs."""
    w = Window.partitionBy(*(by or ("date",)))
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    slope = safe_div(F.covar_pop(u, v).over(w), F.var_pop(u).over(w))
    mean_u, mean_v = F.avg(u).over(w), F.avg(v).over(w)
    return F.when(F.count(u).over(w) >= 2, v - mean_v - F.coalesce(slope, F.lit(0.0)) * (u - mean_u))


def rank_centred(x: Column, limit: float, *by: str) -> Column:
    return clip(2 * (rank(x, *by) - 0.5), -limit, limit)
