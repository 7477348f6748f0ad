"""The published results: computed from the star, stored as CSV with a header."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright.plans import cohorts, funnel, overview, retention, revenue
from cartwright.plans.star import Star, read_star
from cartwright.sources import store


def _dow(star: Star) -> DataFrame:
    return funnel.funnel_by_dow(star).withColumnRenamed("day_of_week", "dow")


PUBLISHED: dict[str, Callable[[Star], DataFrame]] = {
    "overview": overview.overview,
    "funnel_overall": funnel.funnel_overall,
    "funnel_by_price_band": funnel.funnel_by_price_band,
    "funnel_by_dow": _dow,
    "cohorts": cohorts.cohorts,
    "repeat_rates": retention.repeat_rates,
    "buyer_activity": retention.buyer_activity,
    "arpu_by_band": revenue.arpu_aov_by_band,
    "arpu_by_category": revenue.arpu_by_category,
    "quintiles": revenue.quintiles,
}


# What each result's columns hold; a published file is read back as this.
SCHEMAS = {
    "overview": "total_users bigint, buyers bigint, total_revenue decimal(38,2), total_events bigint, "
    "total_sessions bigint, products bigint",
    "funnel_overall": "viewers bigint, cart_adders bigint, purchasers bigint, view_to_cart_pct decimal(38,2), "
    "cart_to_purchase_pct decimal(38,2), overall_conversion_pct decimal(38,2)",
    "funnel_by_price_band": "price_band string, viewers bigint, cart_adders bigint, purchasers bigint, "
    "view_to_cart_pct decimal(38,2), cart_to_purchase_pct decimal(38,2)",
    "funnel_by_dow": "dow int, viewers bigint, cart_adders bigint, purchasers bigint, "
    "view_to_purchase_pct decimal(38,2)",
    "cohorts": "cohort_week date, cohort_size bigint, returned_d7 bigint, returned_d30 bigint, "
    "returned_d60 bigint, d7_rate_pct decimal(38,2), d30_rate_pct decimal(38,2), d60_rate_pct decimal(38,2)",
    "repeat_rates": "first_purchase_band string, first_time_buyers bigint, returned_buyers bigint, "
    "repeat_rate_pct decimal(38,2)",
    "buyer_activity": "first_time_buyers bigint, active_d7_pct decimal(38,2), active_d30_pct decimal(38,2), "
    "active_d60_pct decimal(38,2)",
    "arpu_by_band": "price_band string, buyers bigint, total_revenue decimal(38,2), arpu decimal(38,2), "
    "aov decimal(38,2)",
    "arpu_by_category": "category string, buyers bigint, total_revenue decimal(38,2), arpu decimal(38,2)",
    "quintiles": "quintile int, users bigint, revenue decimal(38,2), revenue_pct decimal(38,2)",
}
# The column that tells a result's rows apart; results without one have one row.
KEYS = {
    "funnel_by_price_band": "price_band",
    "funnel_by_dow": "dow",
    "cohorts": "cohort_week",
    "repeat_rates": "first_purchase_band",
    "arpu_by_band": "price_band",
    "arpu_by_category": "category",
    "quintiles": "quintile",
}


def typed(name: str, result: DataFrame) -> DataFrame:
    """A result with the declared types, the same whether computed or read back."""
    fields = T.StructType.fromDDL(SCHEMAS[name])
    return result.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def publish(name: str, result: DataFrame, run: str) -> None:
    """Store one finished result, a few hundred rows at most, as a single ordered CSV part."""
    result.coalesce(1).write.option("header", True).csv(f"{run}/{name}")


def publish_all(spark: SparkSession, star: Star, root: str, at_once: int = 4) -> str:
    """Publish every result in one run; readers switch to it when all are written.

    The results do not depend on each other, so a few are computed at once.
    """
    run = store.new_run(f"{root}/marts")
    results = {name: plan(star) for name, plan in PUBLISHED.items()}
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(publish, name, result, run) for name, result in results.items()]
        for job in jobs:
            job.result()
    store.commit(spark, run)
    store.prune(spark, f"{root}/marts")
    return run


def read_published(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A result as last published, with its declared types."""
    run = store.latest_run(spark, f"{root}/marts")
    return spark.read.option("header", True).schema(SCHEMAS[name]).csv(f"{run}/{name}")


def cells(name: str, result: DataFrame) -> DataFrame:
    """A result as (result, row_key, column_name, value): a row for each number."""
    key = KEYS.get(name)
    numbers = [c for c in result.columns if c != key]
    row_key = F.col(key).cast("string") if key else F.lit("")
    doubles = result.select(row_key.alias("row_key"), *[F.col(c).cast("double") for c in numbers])
    long = doubles.unpivot(["row_key"], numbers, "column_name", "value")
    return long.select(F.lit(name).alias("result"), "row_key", "column_name", "value")


def compute_or_published(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The live result when a star is stored below root, else the published one.

    Only a missing star falls back; an error in the query itself is raised.
    """
    try:
        star = read_star(spark, root)
    except store.NothingStored:
        return read_published(spark, name, root)
    return typed(name, PUBLISHED[name](star))
