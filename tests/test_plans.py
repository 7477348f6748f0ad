"""The physical plans have the shape that scales, and the star's totals agree."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cartwright.catalog import QUERIES, STAR_PLANS, built
from cartwright.plans import cohorts, funnel, marts, overview, quality, retention, revenue
from cartwright.plans.star import fct_events, product_descriptions, unpriced_products

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return built(spark, SF_DIR)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_dedup_limits_rows_before_the_exchange(tables):
    plan = plan_of(fct_events(tables.raw, unpriced_products(product_descriptions(tables.raw))))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange hashpartitioning(user_id") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize(
    "query", [retention.repeat_rates, revenue.arpu_by_price_band, revenue.aov_by_price_band]
)
def test_purchase_queries_read_the_purchase_folder_only(tables, query):
    scans = [line for line in plan_of(query(tables.star)).splitlines() if "FileScan" in line]
    of_events = [line for line in scans if "type_folder" in line]
    assert of_events and not any("event_type" in line for line in scans)
    assert all("= purchase)" in line.split("PartitionFilters")[1] for line in of_events)


def test_price_filter_is_pushed_and_columns_are_pruned(tables):
    plan = plan_of(revenue.arpu_by_price_band(tables.star))
    assert "GreaterThan(price,0.0000)" in plan
    assert "ReadSchema: struct<product_id:bigint,price:decimal(18,4),user_id:bigint>" in plan


def test_ntile_never_windows_over_users(tables):
    plan = plan_of(revenue.quintiles(tables.star))
    assert "ntile(" not in plan
    # The single partitions left hold one row per bucket of values and one per quintile.
    for after in plan.split("Exchange SinglePartition")[1:]:
        aggregate = after[after.index("HashAggregate") :]
        assert aggregate.startswith(("HashAggregate(keys=[bucket", "HashAggregate(keys=[tile"))


@pytest.mark.parametrize(
    "query", [funnel.funnel_overall, funnel.funnel_by_dow, cohorts.cohorts, retention.buyer_activity,
              revenue.quintiles]
)
def test_user_results_read_the_rollup_only(tables, query):
    scans = [line for line in plan_of(query(tables.star)).splitlines() if "FileScan" in line]
    assert scans and not any("fct_events" in line for line in scans)


def test_published_results_scan_events_rarely(tables):
    plans = [plan_of(plan(tables.star)) for plan in marts.PUBLISHED.values()]
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan" in line]
    assert sum("fct_events" in line for line in scans) <= 6


def test_planning_runs_no_job(spark, tables):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    for plan in STAR_PLANS.values():
        plan(tables.star)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs.getJobIdsForGroup("planning")) == []


def test_funnel_shuffles_users_once(tables):
    plan = plan_of(funnel.funnel_overall(tables.star))
    assert plan.count("Exchange") == 2 and "Expand" not in plan


def test_revenue_agrees_everywhere(tables):
    star = tables.star
    total = overview.overview(star).first()
    for split in (
        revenue.arpu_by_price_band(star).withColumnRenamed("total_revenue", "revenue"),
        revenue.arpu_by_category(star).withColumnRenamed("total_revenue", "revenue"),
        revenue.quintiles(star),
    ):
        got = split.agg(F.sum("revenue").alias("total"), F.count("*").alias("parts")).first()
        # Prices have four decimals here, so every part is off by up to half a cent.
        assert abs(got.total - total.total_revenue) <= Decimal("0.005") * (got.parts + 1)
    sizes = [r.users for r in revenue.quintiles(star).collect()]
    assert max(sizes) - min(sizes) <= 1
    assert sum(sizes) == star.events.where("event_type = 'purchase' and price > 0").select(
        "user_id"
    ).distinct().count()


def test_cohorts_cover_all_users_and_windows_nest(tables):
    table = cohorts.cohorts(tables.star)
    assert table.agg(F.sum("cohort_size")).first()[0] == tables.star.users.count()
    assert table.where(
        "not (returned_d7 <= returned_d30 and returned_d30 <= returned_d60 "
        "and returned_d60 <= cohort_size)"
    ).isEmpty()


def test_keys_hold(tables):
    assert quality.constraint_violations(tables.star).where("violations > 0").isEmpty()


def test_known_slice(spark):
    got = [tuple(r) for r in entry.queries()["funnel_by_price_band"](spark, SF_DIR).collect()]
    assert sorted(got, key=lambda r: r[1]) == [
        ("under_50", 1173, 962, 344, 82.01, 35.76),
        ("50_to_200", 1485, 1443, 922, 97.17, 63.89),
        ("200_to_500", 1498, 1496, 1237, 99.87, 82.69),
        ("over_500", 1499, 1499, 1406, 100.0, 93.8),
    ]
