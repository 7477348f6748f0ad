"""View, cart and purchase reach in distinct users."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.functions import events as E
from cartwright.functions.exact import pct
from cartwright.plans.star import Star

_STAGES = {"viewers": V.VIEW, "cart_adders": V.CART, "purchasers": V.PURCHASE}



def _step_rates() -> list[Column]:
    return [
        pct(F.col("cart_adders"), F.col("viewers")).alias("view_to_cart_pct"),
        pct(F.col("purchasers"), F.col("cart_adders")).alias("cart_to_purchase_pct"),
    ]


def _view_to_purchase(name: str) -> Column:
    return pct(F.col("purchasers"), F.col("viewers")).alias(name)


def _stage_users(events: DataFrame, *slices: Column) -> DataFrame:
    """Users reaching each stage per slice; stages are independent of each other and of order.

    One row of flags per slice and user replaces three distinct counts. The flags are maxima, so
    map tasks reduce a busy user or a popular slice before anything is shuffled.
    """
    return _reached(events, {stage: E.is_type(kind) for stage, kind in _STAGES.items()}, *slices)


def _stage_users_by_day(star: Star, *slices: Column) -> DataFrame:
    """The same for slices of days, from each user's days."""
    flags = {"viewers": F.col("viewed"), "cart_adders": F.col("carted"), "purchasers": F.col("bought")}
    return _reached(star.user_days, flags, *slices)


def _reached(rows: DataFrame, flags: dict[str, Column], *slices: Column) -> DataFrame:
    slices = [s.alias(f"slice_{i}") for i, s in enumerate(slices)]
    per_user = rows.groupBy(*slices, "user_id").agg(*[F.max(f).alias(s) for s, f in flags.items()])
    return per_user.groupBy(*[f"slice_{i}" for i in range(len(slices))]).agg(
        *[F.count_if(F.col(stage)).alias(stage) for stage in _STAGES]
    )


def funnel_overall(star: Star) -> DataFrame:
    return _stage_users_by_day(star).select(
        *_STAGES,
        *_step_rates(),
        _view_to_purchase("overall_conversion_pct"),
    )


def funnel_by_price_band(star: Star) -> DataFrame:
    events = star.events.join(star.products.select("product_id", "price_band"), "product_id")
    return (
        _stage_users(events, F.col("price_band"))
        .select(F.col("slice_0").alias("price_band"), *_STAGES, *_step_rates())
        .orderBy(F.desc("viewers"))
    )


def funnel_by_brand(star: Star, min_viewers: int = 500) -> DataFrame:
    """Brands, as recorded on the product, with enough viewers for stable rates."""
    products = star.products.select("product_id", F.col("brand").alias("product_brand"))
    events = star.events.join(products, "product_id")
    return (
        _stage_users(events, F.coalesce("product_brand", F.lit(V.NO_BRAND)))
        .where(F.col("viewers") >= min_viewers)
        .select(F.col("slice_0").alias("brand"), *_STAGES, *_step_rates())
        .orderBy(F.asc_nulls_last("cart_to_purchase_pct"), F.desc("viewers"))
    )


def funnel_by_dow(star: Star) -> DataFrame:
    """Per weekday of the event, 0 = Sunday."""
    return (
        _stage_users_by_day(star, E.weekday(F.col("day")))
        .select(
            F.col("slice_0").alias("day_of_week"),
            *_STAGES,
            _view_to_purchase("view_to_purchase_pct"),
        )
        .orderBy("day_of_week")
    )
