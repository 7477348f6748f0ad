"""Results arranged for display: labels, business order, long and matrix forms.

All inputs are finished results of a few to a few hundred rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.functions.exact import pct
from cartwright.functions.labels import label, position


def funnel_long(overall: DataFrame) -> DataFrame:
    """The overall funnel as stages, with each stage's share of the first."""
    stages = overall.unpivot(["viewers"], list(V.FUNNEL_STAGE_LABELS), "stage_key", "users")
    # The id column repeats the viewers on every row.
    return stages.select(
        position(F.col("stage_key"), V.FUNNEL_STAGE_LABELS).alias("stage_order"),
        label(F.col("stage_key"), V.FUNNEL_STAGE_LABELS).alias("stage"),
        "users",
        pct(F.col("users"), F.col("viewers")).alias("pct_of_first"),
    ).orderBy("stage_order")


def with_band_labels(result: DataFrame, band: str = "price_band") -> DataFrame:
    """A per-band result with label and rank, in business order."""
    return result.select(
        position(F.col(band), V.PRICE_BAND_LABELS).alias("band_order"),
        label(F.col(band), V.PRICE_BAND_LABELS).alias("label"),
        "*",
    ).orderBy(F.asc_nulls_last("band_order"), band)


def with_weekday_labels(by_dow: DataFrame) -> DataFrame:
    return by_dow.select(
        label(F.col("day_of_week"), V.WEEKDAY_LABELS).alias("day"), "*"
    ).orderBy("day_of_week")


def quintile_shares(quintiles: DataFrame) -> DataFrame:
    labelled = quintiles.withColumn("label", label(F.col("quintile"), V.QUINTILE_LABELS))
    return labelled.orderBy("quintile").select(
        *[F.col(c).alias(heading) for c, heading in V.QUINTILE_HEADINGS.items()]
    )


def cohort_heatmap_long(cohorts: DataFrame) -> DataFrame:
    """One row per window and cohort."""
    rates = {f"d{n}_rate_pct": V.WINDOW_LABELS[n] for n in V.WINDOW_DAYS}
    week = F.date_format("cohort_week", "yyyy-MM-dd").alias("cohort_week")
    return (
        cohorts.select(week, *rates)
        .unpivot(["cohort_week"], list(rates), "rate_name", "rate_pct")
        .orderBy(position(F.col("rate_name"), rates), "cohort_week")
        .select(label(F.col("rate_name"), rates).alias("window"), "cohort_week", "rate_pct")
    )


def _by_window(cohorts: DataFrame) -> DataFrame:
    """The long form with each window's place."""
    order = {name: days for days, name in V.WINDOW_LABELS.items()}
    return cohort_heatmap_long(cohorts).withColumn("place", position(F.col("window"), order))


def cohort_heatmap(cohorts: DataFrame) -> DataFrame:
    """One row per window; its cells, ``week=rate`` by week, as one text."""
    cells = F.transform(
        F.array_sort(F.collect_list(F.struct("cohort_week", "rate_pct"))),
        lambda cell: F.concat(cell["cohort_week"], F.lit("="), cell["rate_pct"].cast("string")),
    )
    rows = _by_window(cohorts).groupBy("place", "window").agg(F.array_join(cells, ",").alias("cells"))
    return rows.orderBy("place").select("window", "cells")


def cohort_heatmap_wide(cohorts: DataFrame, weeks: list[str]) -> DataFrame:
    """Windows as rows, the given cohort weeks as columns."""
    wide = _by_window(cohorts).groupBy("place", "window").pivot("cohort_week", weeks)
    return wide.agg(F.first("rate_pct")).orderBy("place").drop("place")


def cohort_table(cohorts: DataFrame) -> DataFrame:
    text = cohorts.orderBy("cohort_week").withColumn(
        "cohort_week", F.date_format("cohort_week", "yyyy-MM-dd")
    )
    return text.select(*[F.col(c).alias(heading) for c, heading in V.COHORT_HEADINGS.items()])


def repeat_table(repeat_rates: DataFrame) -> DataFrame:
    labelled = repeat_rates.withColumn(
        "label", label(F.col("first_purchase_band"), V.PRICE_BAND_LABELS)
    )
    return labelled.select(*[F.col(c).alias(heading) for c, heading in V.REPEAT_HEADINGS.items()])


def top_categories(by_category: DataFrame, limit: int = 10) -> DataFrame:
    """The best-selling named categories, lowest revenue per buyer first."""
    best = (
        by_category.where(F.col("category") != V.NO_CATEGORY)
        .orderBy(F.desc_nulls_first("total_revenue"), "category")
        .limit(limit)
    )
    return best.orderBy(F.asc_nulls_last("arpu"), "category")
