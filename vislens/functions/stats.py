"""Rates, intervals and guarded ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(num: Column, den: Column) -> Column:
    """num/den as double; null (undefined) when the denominator is zero or null."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def whole_sum(c: Column, unit: int = 1_000_000) -> Column:
    """Sum of whole numbers as decimal(38, 0): sums that leave the range of bigint are exact too.

    Quotients and remainders are summed as bigints, which is cheaper than summing decimals.
    """
    high, low = F.sum(F.call_function("div", c, F.lit(unit))), F.sum(c % unit)
    return (high.cast("decimal(25, 0)") * F.lit(unit).cast("decimal(7, 0)") + low).cast("decimal(38, 0)")


def wilson(num: Column, den: Column, upper: bool, z: float = Z95) -> Column:
    """Wilson score bound clipped to [0, 1]; null when the denominator is zero."""
    n = F.nullif(den.cast("double"), F.lit(0.0))
    p = num.cast("double") / n
    base = F.lit(1.0) + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (n * 2.0)) / base
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (n * n * 4.0)) / base
    bound = F.least(F.lit(1.0), center + half) if upper else F.greatest(F.lit(0.0), center - half)
    return F.when(n.isNotNull(), bound)  # least and greatest skip nulls


def rate_columns(num: Column, den: Column, prefix: str = "", digits: int = 6) -> list[Column]:
    """numerator, denominator, defined flag, rate and its 95 % Wilson interval."""
    p = prefix
    return [
        num.cast("bigint").alias(p + "num"),
        den.cast("bigint").alias(p + "den"),
        (den > 0).alias(p + "defined"),
        F.round(ratio(num, den), digits).alias(p + "rate"),
        F.round(wilson(num, den, upper=False), digits).alias(p + "lo"),
        F.round(wilson(num, den, upper=True), digits).alias(p + "hi"),
    ]
