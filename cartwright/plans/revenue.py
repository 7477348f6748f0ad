"""Revenue per buyer, per order and by spend. Revenue is purchases with a positive price."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.functions.exact import money, pct, ratio_2dp
from cartwright.operators.ntile import ntile_of_values
from cartwright.plans.star import Star


def _paid(star: Star) -> DataFrame:
    return star.purchases.where(F.col("price") > 0)


def _revenue_by(star: Star, slice_name: str, value: Column) -> DataFrame:
    """Buyers, purchases and exact revenue per product attribute, one row per buyer first."""
    products = star.products.select("product_id", value.alias(slice_name))
    per_buyer = (
        _paid(star)
        .join(products, "product_id")
        .groupBy(slice_name, "user_id")
        .agg(F.count("*").alias("purchases"), F.sum("price").alias("spend"))
    )
    return per_buyer.groupBy(slice_name).agg(
        F.count("*").alias("buyers"),
        F.sum("purchases").alias("purchase_events"),
        F.sum("spend").alias("revenue"),
    )


def _total() -> Column:
    return money(F.col("revenue")).alias("total_revenue")


def _arpu() -> Column:
    return ratio_2dp(F.col("revenue"), F.col("buyers")).alias("arpu")


def _aov() -> Column:
    return ratio_2dp(F.col("revenue"), F.col("purchase_events")).alias("aov")


def arpu_by_price_band(star: Star) -> DataFrame:
    return (
        _revenue_by(star, "price_band", F.col("price_band"))
        .select("price_band", "buyers", _total(), _arpu())
        .orderBy(F.desc_nulls_first("arpu"))
    )


def arpu_by_category(star: Star) -> DataFrame:
    return (
        _revenue_by(star, "category", F.coalesce("category", F.lit(V.NO_CATEGORY)))
        .select("category", "buyers", _total(), _arpu())
        .orderBy(F.desc_nulls_first("total_revenue"))
    )


def aov_by_price_band(star: Star) -> DataFrame:
    """Revenue per purchase event."""
    return (
        _paid(star)
        .join(star.products.select("product_id", "price_band"), "product_id")
        .groupBy("price_band")
        .agg(F.count("*").alias("purchase_events"), F.sum("price").alias("revenue"))
        .select("price_band", "purchase_events", _total(), _aov())
        .orderBy(F.desc_nulls_first("aov"))
    )


def arpu_aov_by_band(star: Star) -> DataFrame:
    return (
        _revenue_by(star, "price_band", F.col("price_band"))
        .select("price_band", "buyers", _total(), _arpu(), _aov())
        .orderBy(F.desc_nulls_first("arpu"))
    )


def quintiles(star: Star, tiles: int = 5) -> DataFrame:
    """Buyers split into equal groups by spend, highest first, with each group's revenue."""
    spend = (
        star.user_days.where(F.col("spend").isNotNull())
        .groupBy("user_id")
        .agg(F.sum("spend").alias("total_spend"))
    )
    per_tile = (
        ntile_of_values(spend, "total_spend", tiles)
        .groupBy(F.col("tile").alias("quintile"))
        .agg(
            F.sum("rows").alias("users"),
            F.sum(F.col("total_spend") * F.col("rows").cast("decimal(18,0)")).alias("revenue"),
        )
    )
    everyone = F.sum("revenue").over(Window.partitionBy())
    return per_tile.select(
        "quintile",
        "users",
        money(F.col("revenue")).alias("revenue"),
        pct(F.col("revenue"), everyone).alias("revenue_pct"),
    ).orderBy("quintile")
