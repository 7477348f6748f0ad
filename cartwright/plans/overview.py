"""Headline figures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions.exact import money
from cartwright.plans.star import Star


def overview(star: Star) -> DataFrame:
    """One row of totals; one row per user first, then three plain counts side by side."""
    per_user = star.user_days.groupBy("user_id").agg(
        F.sum("events").alias("events"), F.max("bought").alias("bought"), F.sum("spend").alias("spend")
    )
    products = star.events.select("product_id").distinct().agg(F.count("*"))
    sessions = star.sessions.agg(F.count("*"))
    return per_user.agg(
        F.count("*").alias("total_users"),
        F.count_if("bought").alias("buyers"),
        money(F.sum("spend")).alias("total_revenue"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
    ).select(
        "*",
        sessions.scalar().alias("total_sessions"),
        products.scalar().alias("products"),
    )
