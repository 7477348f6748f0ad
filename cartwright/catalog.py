"""Every query by name, over the star built from a folder of order tables.

The star is built and stored once per application and input version; all queries then read the
stored tables, as they would in production.
"""

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright.plans import cohorts, funnel, marts, overview, quality, retention, revenue, shapes
from cartwright.plans import star as star_plans
from cartwright.plans.star import Star
from cartwright.session import deal, prepare, work_dir
from cartwright.sources import csv_events, store
from cartwright.sources.order_lines import INPUT_TABLES, events_from_order_lines

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Built:
    """Stored raw events and star of one input version."""

    root: str
    raw: DataFrame
    star: Star


_built: dict[tuple, Built] = {}


def _input_version(spark: SparkSession, sf_dir: str) -> tuple:
    return tuple(store.content_version(spark, f"{sf_dir}/{t}.parquet") for t in INPUT_TABLES)


def build(spark: SparkSession, sf_dir: str) -> Built:
    """Derive and store the raw events of these inputs and the star over them."""
    prepare(spark)
    inputs = f"{work_dir(spark)}/inputs/{zlib.crc32(sf_dir.encode()):08x}"
    root = store.new_run(inputs)
    deal(spark, sum(size for _, size, _ in _input_version(spark, sf_dir)))
    csv_events.store_raw(spark, events_from_order_lines(spark, sf_dir), root)
    star_plans.run_build(spark, root)
    store.commit(spark, root)
    store.prune(spark, inputs)
    return Built(root, csv_events.raw_events(spark, root), star_plans.read_star(spark, root))


def built(spark: SparkSession, sf_dir: str) -> Built:
    """The tables of these inputs, built on first use and after every change of the inputs."""
    prepare(spark)
    key = (work_dir(spark), sf_dir, _input_version(spark, sf_dir))
    if key not in _built or not store.is_committed(spark, _built[key].root):
        _built[key] = build(spark, sf_dir)
    return _built[key]


def comparable(result: DataFrame) -> DataFrame:
    """Types every engine prints alike: ISO text for times and dates, doubles for decimals."""
    columns = []
    for field in result.schema:
        column = F.col(f"`{field.name}`")
        name = field.name
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DayTimeIntervalType):
            epoch = F.timestamp_micros(F.lit(0))
            column, name = F.unix_micros(epoch + column), f"{name}_us"
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(name))
    return result.select(*columns)


def _on_star(plan: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(plan(built(spark, sf_dir).star))


def _on_raw(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(plan(built(spark, sf_dir).raw))


def _raw_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events written as CSV text and loaded again."""
    source = built(spark, sf_dir).raw
    run = store.new_run(f"{work_dir(spark)}/csv")
    text = source.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS z"))
    text.write.option("header", True).csv(f"{run}/events")
    csv_events.load_events(spark, f"{run}/events", run)
    store.commit(spark, run)
    store.prune(spark, f"{work_dir(spark)}/csv")
    return comparable(csv_events.raw_events(spark, run))


def _published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the published results, read back from their CSV files."""
    tables = built(spark, sf_dir)
    root = tables.root
    marts.publish_all(spark, tables.star, root)
    counts = [
        marts.read_published(spark, name, root).agg(
            F.lit(name).alias("result"), F.count("*").alias("row_count")
        )
        for name in marts.PUBLISHED
    ]
    return reduce(DataFrame.unionAll, counts)


def _published_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published funnel, from its CSV."""
    tables = built(spark, sf_dir)
    root = tables.root
    run = store.new_run(f"{root}/marts")
    marts.publish("funnel_overall", marts.PUBLISHED["funnel_overall"](tables.star), run)
    store.commit(spark, run)
    published = marts.read_published(spark, "funnel_overall", root)
    return published.select(
        *[
            F.col(c).cast("double" if c.endswith("_pct") else "bigint").alias(c)
            for c in published.columns
        ]
    )


def _published_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the ten published results, read back from their CSV files."""
    tables = built(spark, sf_dir)
    marts.publish_all(spark, tables.star, tables.root)
    parts = [
        marts.cells(name, marts.read_published(spark, name, tables.root)) for name in marts.PUBLISHED
    ]
    return reduce(DataFrame.unionAll, parts)


def _published_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by category where only published results are left: read back with its types."""
    tables = built(spark, sf_dir)
    root = store.new_run(f"{work_dir(spark)}/fallback")
    run = store.new_run(f"{root}/marts")
    marts.publish("arpu_by_category", marts.PUBLISHED["arpu_by_category"](tables.star), run)
    store.commit(spark, run)
    store.commit(spark, root)
    store.prune(spark, f"{work_dir(spark)}/fallback")
    return comparable(marts.compute_or_published(spark, "arpu_by_category", root))


def _raw_count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("row_count"))


RAW_PLANS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw_events_row_count": _raw_count,
    "profile_nulls": quality.null_counts,
    "profile_exact_dups": quality.exact_duplicates,
    "profile_near_dups": quality.same_second_duplicates,
    "profile_midnight": quality.midnight_sessions,
    "profile_price": quality.price_anomalies,
    "profile_event_types": quality.event_types,
    "profile_date_range": quality.date_range,
    "profile_report": quality.profile,
}

STAR_PLANS: dict[str, Callable[[Star], DataFrame]] = {
    # star schema
    "dim_users": lambda s: s.users,
    "dim_products": lambda s: s.products,
    "fct_sessions": lambda s: s.sessions,
    "fct_events": lambda s: s.events,
    "star_row_counts": star_plans.row_counts,
    "constraint_violations": quality.constraint_violations,
    # funnel
    "funnel_overall": funnel.funnel_overall,
    "funnel_by_price_band": funnel.funnel_by_price_band,
    "funnel_by_brand": funnel.funnel_by_brand,
    "funnel_by_dow": funnel.funnel_by_dow,
    # cohorts and retention
    "cohorts": cohorts.cohorts,
    "cohort_d60_status": cohorts.cohort_d60_status,
    "repeat_rates": retention.repeat_rates,
    "buyer_activity": retention.buyer_activity,
    # revenue
    "arpu_by_price_band": revenue.arpu_by_price_band,
    "arpu_by_category": revenue.arpu_by_category,
    "aov_by_price_band": revenue.aov_by_price_band,
    "arpu_aov_by_band": revenue.arpu_aov_by_band,
    "quintiles": revenue.quintiles,
    "overview": overview.overview,
    # display shapes
    "funnel_long": lambda s: shapes.funnel_long(funnel.funnel_overall(s)),
    "bands_labelled": lambda s: shapes.with_band_labels(funnel.funnel_by_price_band(s)),
    "arpu_bands_labelled": lambda s: shapes.with_band_labels(revenue.arpu_aov_by_band(s)),
    "weekdays_labelled": lambda s: shapes.with_weekday_labels(funnel.funnel_by_dow(s)),
    "cohort_heatmap_long": lambda s: shapes.cohort_heatmap_long(cohorts.cohorts(s)),
    "cohort_heatmap": lambda s: shapes.cohort_heatmap(cohorts.cohorts(s)),
    "cohort_table": lambda s: shapes.cohort_table(cohorts.cohorts(s)),
    "repeat_table": lambda s: shapes.repeat_table(retention.repeat_rates(s)),
    "top_categories": lambda s: shapes.top_categories(revenue.arpu_by_category(s)),
    "quintile_shares_labelled": lambda s: shapes.quintile_shares(revenue.quintiles(s)),
}

QUERIES: dict[str, Query] = {
    **{name: _on_raw(plan) for name, plan in RAW_PLANS.items()},
    **{name: _on_star(plan) for name, plan in STAR_PLANS.items()},
    "raw_events_through_csv": _raw_through_csv,
    "published_row_counts": _published_rows,
    "published_funnel": _published_funnel,
    "published_cells": _published_cells,
    "published_fallback": _published_fallback,
}
