"""Weekly cohorts by first appearance."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.functions.exact import pct
from cartwright.plans.star import Star


def cohorts(star: Star) -> DataFrame:
    """Cohort size and users purchasing on day 1..7, 1..30 and 1..60 after first_seen.

    Every user counts in the size. A user is inside a window exactly when their first purchase
    day after the day of first_seen is, so one number per user answers all windows. Only users
    with a raw purchase can have one, which keeps the rest out of the join.
    """
    sizes = star.users.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"))

    buyers = star.users.where(F.col("first_purchase").isNotNull()).select(
        "user_id", "cohort_week", F.to_date("first_seen").alias("first_day")
    )
    purchase_days = star.user_days.where("bought").select("user_id", "day")
    first_return = (
        buyers.join(purchase_days, "user_id")
        .where(F.col("day") > F.col("first_day"))
        .groupBy("user_id", "cohort_week")
        .agg(F.min(F.datediff("day", "first_day")).alias("gap"))
    )
    returns = first_return.groupBy("cohort_week").agg(
        *[F.count_if(F.col("gap") <= n).alias(f"returned_d{n}") for n in V.WINDOW_DAYS]
    )

    returned = [f"returned_d{n}" for n in V.WINDOW_DAYS]
    return (
        sizes.join(returns, "cohort_week", "left")
        .fillna(0, returned)
        .select(
            "cohort_week",
            "cohort_size",
            *returned,
            *[
                pct(F.col(f"returned_d{n}"), F.col("cohort_size")).alias(f"d{n}_rate_pct")
                for n in V.WINDOW_DAYS
            ],
        )
        .orderBy("cohort_week")
    )


def cohort_d60_status(star: Star) -> DataFrame:
    """Whether the data reaches 60 days past each cohort's Monday."""
    last_day = star.events.agg(F.to_date(F.max("event_time"))).scalar()
    return (
        star.users.groupBy("cohort_week")
        .agg(F.count("*").alias("cohort_size"))
        .withColumn("max_event_date", last_day)
        .withColumn("d60_eligible_through", F.date_add("cohort_week", 60))
        .withColumn(
            "d60_status",
            F.when(
                F.col("d60_eligible_through") > F.col("max_event_date"), V.INCOMPLETE_D60
            ).otherwise(V.COMPLETE_D60),
        )
        .orderBy("cohort_week")
    )
