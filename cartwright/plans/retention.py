"""What buyers do after their first purchase."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.functions.exact import pct
from cartwright.plans.star import Star


def _buyers(star: Star) -> DataFrame:
    return star.users.where(F.col("first_purchase").isNotNull()).select("user_id", "first_purchase")


def repeat_rates(star: Star) -> DataFrame:
    """First-time and returning buyers per price band of the first purchase.

    The first purchase needs a positive price; the repeat is any later purchase. Somebody who
    first bought products of two bands at one moment counts in both. Whether a later purchase
    exists is read off the user's last one, so purchases are never joined to each other.
    """
    last_purchase = (
        star.user_days.where("bought").groupBy("user_id").agg(F.max("last_purchase_at").alias("last_purchase"))
    )
    buyers = _buyers(star).join(last_purchase, "user_id")

    first_items = star.purchases.where(F.col("price") > 0).select(
        "user_id", F.col("event_time").alias("first_purchase"), "product_id"
    )
    per_buyer = (
        first_items.join(buyers, ["user_id", "first_purchase"])
        .join(star.products.select("product_id", "price_band"), "product_id")
        .groupBy("price_band", "user_id")
        .agg(F.max(F.col("last_purchase") > F.col("first_purchase")).alias("returned"))
    )
    return (
        per_buyer.groupBy(F.col("price_band").alias("first_purchase_band"))
        .agg(
            F.count("*").alias("first_time_buyers"),
            F.count_if("returned").alias("returned_buyers"),
        )
        .withColumn("repeat_rate_pct", pct(F.col("returned_buyers"), F.col("first_time_buyers")))
        .orderBy(F.desc_nulls_first("repeat_rate_pct"))
    )


def buyer_activity(star: Star) -> DataFrame:
    """Share of buyers whose next event of any type falls 1..7, 1..30 and 1..60 days later.

    The gap is taken to the very next event first and tested against the window second: a buyer
    with another event on the day of purchase has gap 0 and is active in no window.
    """
    next_day = (
        _buyers(star)
        .join(star.user_days.select("user_id", "day", "last_at"), "user_id")
        .where(F.col("last_at") > F.col("first_purchase"))
        .groupBy("user_id")
        .agg(F.min(F.datediff("day", F.to_date("first_purchase"))).alias("gap"))
    )
    active = next_day.agg(
        *[F.count_if(F.col("gap").between(1, n)).alias(f"active_d{n}") for n in V.WINDOW_DAYS]
    )
    buyers = _buyers(star).agg(F.count("*").alias("first_time_buyers"))
    return active.withColumn("first_time_buyers", buyers.scalar()).select(
        "first_time_buyers",
        *[
            pct(F.col(f"active_d{n}"), F.col("first_time_buyers")).alias(f"active_d{n}_pct")
            for n in V.WINDOW_DAYS
        ],
    )
