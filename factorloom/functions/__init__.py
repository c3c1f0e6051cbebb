"""Scalar functions with the null, zero and infinity rules that factors need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: Largest finite 32-bit float; fixed value.
FLOAT_MAX = 3.4028235e38


def no_nan(x: Column) -> Column:
    """NULL for NaN: NULL is the only missing value here."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.abs(x) < INF, x)


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the divisor is 0."""
    return F.try_divide(a, b)


def ieee_div(a: Column, b: Column) -> Column:
    """Signed infinity where the divisor is 0, NULL for 0/0."""
    return F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))).otherwise(F.try_divide(a, b))


def flag(condition: Column) -> Column:
    """A comparison that is false, not NULL, where an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def to_float(x: Column) -> Column:
    """32-bit float; NULL outside its range."""
    x = x.cast("double")
    return F.when(F.abs(x) <= FLOAT_MAX, x).cast("float")


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(p)))


def clip(x: Column, low: float, high: float) -> Column:
    """Like least/greatest, but NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
