"""The star schema: users, products, sessions and deduplicated events."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright import fixed_values as V
from cartwright import schemas
from cartwright.functions import events as E
from cartwright.operators import repeated_keys
from cartwright.operators.first_row import first_row_of_repeated, first_row_per_key
from cartwright.plans.activity import user_days
from cartwright.session import deal
from cartwright.sources import store
from cartwright.sources.csv_events import raw_bytes, raw_events


class Star:
    """The four tables; each is opened, and its files listed, when first used."""

    def __init__(self, table: Callable[[str], DataFrame]):
        self._table = table

    @cached_property
    def users(self) -> DataFrame:
        return self._table("dim_users")

    @cached_property
    def products(self) -> DataFrame:
        return self._table("dim_products")

    @cached_property
    def sessions(self) -> DataFrame:
        return self._table("fct_sessions")

    @cached_property
    def events(self) -> DataFrame:
        return self._table("fct_events")

    @cached_property
    def user_days(self) -> DataFrame:
        """What each user did on each day."""
        return self._table("user_days")

    @cached_property
    def purchases(self) -> DataFrame:
        """The purchase rows of fct_events."""
        return self._table("purchases")


TABLES = {
    "dim_users": schemas.DIM_USERS,
    "dim_products": schemas.DIM_PRODUCTS,
    "fct_sessions": schemas.FCT_SESSIONS,
    "fct_events": schemas.FCT_EVENTS,
}
_STORED = TABLES | {"user_days": schemas.USER_DAYS}
# Purchases are a few percent of events; a folder of their own lets purchase queries skip the
# rest. Types are free text, so all but the three known ones share a folder.
_FOLDER = T.StructField("type_folder", T.StringType())
_OTHER_TYPES = "other"


def dim_users(raw: DataFrame) -> DataFrame:
    """Users over all raw events, duplicates and session-less events included."""
    first_seen = F.min("event_time")
    return raw.groupBy("user_id").agg(
        first_seen.alias("first_seen"),
        F.min(F.when(E.is_type(V.PURCHASE), F.col("event_time"))).alias("first_purchase"),
        E.cohort_monday(first_seen).alias("cohort_week"),
    )


#: How a price is put behind a time in one number: prices have 18 digits, 4 of them decimals.
_PRICE_DIGITS = 18
_PRICE_DECIMALS = 4


def _time_then_price() -> Column:
    """Time and price as one number of the same order, which hash aggregation can keep in place."""
    micros = F.unix_micros("event_time").cast("decimal(20,0)")
    scaled = (F.col("price").cast("decimal(18,4)") * F.lit(10**_PRICE_DECIMALS)).cast("decimal(18,0)")
    return (micros * F.lit(10**_PRICE_DIGITS).cast("decimal(19,0)") + scaled).cast("decimal(38,0)")


def product_descriptions(raw: DataFrame) -> DataFrame:
    """Each brand and category a product was shown with: its latest priced event, its top price.

    Time and price are one number, so a map task keeps a row for each brand and category of a product,
    whatever the product's volume and however its price moves.
    """
    priced = F.when(F.col("price") > 0, _time_then_price())
    return raw.groupBy("product_id", "brand", "category_code").agg(
        F.max(priced).alias("latest"), F.max("price").alias("top_price")
    )


def dim_products(described: DataFrame) -> DataFrame:
    """Products as described by their latest event with a positive price.

    Of events at one time the one of the highest price counts, then brand and category in
    order, missing ones last.
    """
    brand, category = F.col("brand"), F.col("category_code")
    first = F.struct(
        -F.col("latest"), brand.isNull(), brand.alias("brand"), category.isNull(), category.alias("category_code")
    )
    best = described.where("latest is not null").groupBy("product_id").agg(
        F.min(first).alias("first"), F.max("latest").alias("latest")
    )
    price = F.pmod("latest", F.lit(10**_PRICE_DIGITS).cast("decimal(38,0)")) / F.lit(10**_PRICE_DECIMALS)
    return best.select(
        "product_id",
        F.col("first.brand").alias("brand"),
        E.top_category(F.col("first.category_code")).alias("category"),
        E.price_band(price).alias("price_band"),
    )


def unpriced_products(described: DataFrame) -> DataFrame:
    """Products that never had a positive price: exactly those absent from dim_products."""
    return (
        described.groupBy("product_id")
        .agg(F.max("top_price").alias("top_price"))
        .where(F.col("top_price") <= 0)
        .select("product_id")
    )


def fct_sessions(raw: DataFrame) -> DataFrame:
    first, last = F.min("event_time"), F.max("event_time")
    return (
        raw.where(F.col("user_session").isNotNull())
        .groupBy(F.col("user_session").alias("session_id"))
        .agg(
            F.min("user_id").alias("user_id"),
            first.alias("session_start"),
            (last - first).alias("session_duration"),
            F.count("*").alias("event_count"),
            F.bool_or(E.is_type(V.PURCHASE)).alias("converted"),
        )
    )


#: What makes two events one.
_EVENT_KEYS = ("user_id", "product_id", "event_type")


def _event_keys() -> list[Column]:
    return [*map(F.col, _EVENT_KEYS), E.second_bucket(F.col("event_time"))]


def repeated_events(raw: DataFrame) -> DataFrame:
    """Digests of the keys that several raw events share, also those that fct_events leaves out."""
    return repeated_keys.repeated_digests(raw, _event_keys())


def fct_events(
    raw: DataFrame, unpriced: DataFrame, seen: DataFrame | None = None, seen_size: int = 1
) -> DataFrame:
    """Events of a session and a priced product, one per user, product, type and second.

    Keeping rows whose product is in dim_products is the same as dropping the unpriced ones, and
    that list is short, so Spark can broadcast it instead of shuffling all events by product.
    Users and sessions need no such test: both tables hold every key of these raw rows. With the
    filter ``seen`` of repeated keys only the events that may be repeated are sorted and exchanged.
    """
    kept = raw.where(F.col("user_session").isNotNull()).join(unpriced, "product_id", "left_anti")
    order = [
        F.asc("event_time"),
        F.asc("price"),
        F.asc("category_id"),
        F.asc_nulls_last("category_code"),
        F.asc_nulls_last("brand"),
        F.asc("user_session"),
    ]
    if seen is None:
        first = first_row_per_key(kept, _event_keys(), order)
    else:
        first = first_row_of_repeated(kept, _event_keys(), order, seen, seen_size)
    return first.select(*V.RAW_COLUMNS)


#: Size of the filter where nothing is stored whose count could tell a better one.
_PLANNED_FILTER_ROWS = 64


def build_star(raw: DataFrame) -> Star:
    """The tables as plans over raw, nothing stored."""

    def events() -> DataFrame:
        seen = repeated_keys.filter_of(repeated_events(raw), _PLANNED_FILTER_ROWS)
        return fct_events(raw, unpriced_products(product_descriptions(raw)), seen, _PLANNED_FILTER_ROWS)

    plans = {
        "dim_users": lambda: dim_users(raw),
        "dim_products": lambda: dim_products(product_descriptions(raw)),
        "fct_sessions": lambda: fct_sessions(raw),
        "fct_events": events,
        "user_days": lambda: user_days(events()),
        "purchases": lambda: events().where(E.is_type(V.PURCHASE)),
    }
    return Star(lambda name: plans[name]())


def run_build(spark: SparkSession, root: str, at_once: int = 4) -> DataFrame:
    """Rebuild and store the star below root from the stored raw table; rows per table.

    Tables that don't need each other are written at the same time.
    """
    raw = raw_events(spark, root)
    if raw.isEmpty():
        raise ValueError("raw_events is empty; load a CSV first")
    deal(spark, raw_bytes(spark, root))
    run = store.new_run(f"{root}/star")

    def write_events() -> None:
        # Lists and filter are stored first, so that their real sizes decide how fct_events uses them.
        store.write_table(product_descriptions(raw), f"{run}/product_descriptions")
        described = spark.read.parquet(f"{run}/product_descriptions")
        store.write_table(unpriced_products(described), f"{run}/unpriced_products")
        store.write_table(dim_products(described), f"{run}/dim_products")
        store.write_table(repeated_events(raw), f"{run}/repeated_events")
        repeated = store.read_table(spark, f"{run}/repeated_events", repeated_keys.DIGESTS)
        size = repeated_keys.filter_rows(repeated.count())
        store.write_table(repeated_keys.filter_of(repeated, size), f"{run}/repeated_filter")
        seen = spark.read.parquet(f"{run}/repeated_filter")
        unpriced = spark.read.schema("product_id bigint").parquet(f"{run}/unpriced_products")
        known = F.col("event_type").isin(V.VIEW, V.CART, V.PURCHASE)
        folder = F.when(known, F.col("event_type")).otherwise(_OTHER_TYPES)
        events = fct_events(raw, unpriced, seen, size).withColumn(_FOLDER.name, folder)
        store.write_table(events, f"{run}/fct_events", (_FOLDER.name,))
        stored = store.read_table(spark, f"{run}/fct_events", schemas.FCT_EVENTS)
        store.write_table(user_days(stored), f"{run}/user_days")

    with ThreadPoolExecutor(at_once) as pool:
        jobs = [
            pool.submit(write_events),
            pool.submit(lambda: store.write_table(dim_users(raw), f"{run}/dim_users")),
            pool.submit(lambda: store.write_table(fct_sessions(raw), f"{run}/fct_sessions")),
        ]
        for job in jobs:
            job.result()
    store.commit(spark, run)
    store.prune(spark, f"{root}/star")
    return row_counts(read_star(spark, root))


def read_star(spark: SparkSession, root: str) -> Star:
    """The star as last built below root."""
    run = store.latest_run(spark, f"{root}/star")

    def open_table(name: str) -> DataFrame:
        if name != "purchases":
            return store.read_table(spark, f"{run}/{name}", _STORED[name])
        with_folder = T.StructType([*schemas.FCT_EVENTS, _FOLDER])
        events = store.read_table(spark, f"{run}/fct_events", with_folder)
        return events.where(F.col(_FOLDER.name) == V.PURCHASE).drop(_FOLDER.name)

    return Star(open_table)


def row_counts(star: Star) -> DataFrame:
    counts = [
        table.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name, table in zip(TABLES, (star.users, star.products, star.sessions, star.events))
    ]
    first, *others = counts
    for other in others:
        first = first.unionAll(other)
    return first
