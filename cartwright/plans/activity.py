"""What each user did on each day: the exact rollup that the user-level results share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.functions import events as E


def user_days(events: DataFrame) -> DataFrame:
    """One row per user and day: which stages were reached, how many events, the spend of paid
    purchases (null without any), and the times of the last event and the last purchase.

    Cohort and retention windows compare days and need the last time within a day only, so this
    answers them exactly, with at most one row a day for even the busiest user.
    """
    at = F.col("event_time")
    return events.groupBy("user_id", F.to_date(at).alias("day")).agg(
        F.max(E.is_type(V.VIEW)).alias("viewed"),
        F.max(E.is_type(V.CART)).alias("carted"),
        F.max(E.is_type(V.PURCHASE)).alias("bought"),
        F.count("*").alias("events"),
        F.sum(F.when(E.is_paid_purchase(), F.col("price"))).alias("spend"),
        F.max(at).alias("last_at"),
        F.max(F.when(E.is_type(V.PURCHASE), at)).alias("last_purchase_at"),
    )
