"""Exact two-place rounding of ratios, half away from zero, without doubles.

Dividing first and rounding the quotient rounds twice, which shifts a cent when the quotient
falls just under a half. Whole-number division of scaled decimals rounds once.
Numerators and denominators here are never negative.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERATOR = "decimal(34,4)"
_CENTS = "decimal(20,0)"


def ratio_2dp(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to two places; NULL over zero."""
    over = F.nullif(denominator.cast(_NUMERATOR), F.lit(0).cast(_NUMERATOR))
    cents = F.call_function("div", numerator.cast(_NUMERATOR) * 200 + over, over * 2)
    return (cents.cast(_CENTS) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def pct(part: Column, whole: Column) -> Column:
    """part as a percentage of whole, to two places; NULL when whole is zero."""
    return ratio_2dp(part.cast("decimal(31,4)") * 100, whole)


def money(total: Column) -> Column:
    """A decimal amount to cents."""
    return F.round(total, 2).cast("decimal(38,2)")
