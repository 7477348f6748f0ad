"""Attributes derived from one event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwright import fixed_values as V


def price_band(price: Column) -> Column:
    (first_limit, first_name), *middle, (_, last_name) = V.PRICE_BANDS
    band = F.when(price < first_limit, first_name)
    for limit, name in middle:
        band = band.when(price < limit, name)
    return band.otherwise(last_name)


def top_category(category_code: Column) -> Column:
    """Text before the first dot; a blank one counts as missing."""
    return F.nullif(F.split_part(category_code, F.lit("."), F.lit(1)), F.lit(""))


def cohort_monday(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def second_bucket(ts: Column) -> Column:
    """The calendar second, as whole seconds since 1970."""
    return F.unix_seconds(ts)


def is_type(event_type: str) -> Column:
    return F.col("event_type") == event_type


def is_paid_purchase() -> Column:
    return is_type(V.PURCHASE) & (F.col("price") > 0)
