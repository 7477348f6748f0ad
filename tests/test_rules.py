"""One hand-made case per rule of the data model and the analyses."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from micro import at, event, raw_table, rows

from cartwright.plans import cohorts, funnel, overview, quality, retention, revenue, shapes
from cartwright.plans.star import build_star, dim_products, product_descriptions, dim_users, fct_sessions


def micros(frame, column="event_time"):
    return sorted(r[0] for r in frame.selectExpr(f"unix_micros({column})").collect())


def us(text):
    return int(at(text).timestamp() * 1_000_000)


def star_of(spark, *events):
    return build_star(raw_table(spark, *events))


def test_same_second_keeps_the_earliest(spark):
    star = star_of(
        spark, event("2020-10-05 10:00:10.600"), event("2020-10-05 10:00:10.100")
    )
    assert micros(star.events) == [us("2020-10-05 10:00:10.100")]
    assert rows(star.sessions, "event_count") == [(2,)]


def test_second_boundary_keeps_both(spark):
    star = star_of(spark, event("2020-10-05 10:00:10.900"), event("2020-10-05 10:00:11.100"))
    assert star.events.count() == 2


def test_same_second_with_other_product_type_or_user_is_no_duplicate(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:10"),
        event("2020-10-05 10:00:10", product=2),
        event("2020-10-05 10:00:10", kind="cart"),
        event("2020-10-05 10:00:10", user=2),
    )
    assert star.events.count() == 4


def test_null_session_rows_only_make_users(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", user=1),
        event("2020-10-05 10:00:00", user=2, session=None),
    )
    assert rows(star.events, "user_id") == [(1,)]
    assert rows(star.sessions, "session_id") == [("s1",)]
    assert rows(star.users, "user_id") == [(1,), (2,)]


def test_midnight_check_counts_the_null_group(spark):
    raw = raw_table(
        spark,
        event("2020-10-05 10:00:00", session=None),
        event("2020-10-06 10:00:00", session=None),
        event("2020-10-05 10:00:00", session="a"),
        event("2020-10-05 23:59:59", session="a"),
        event("2020-10-05 23:59:59", session="b"),
        event("2020-10-06 00:00:00", session="b"),
    )
    assert rows(quality.midnight_sessions(raw)) == [(2,)]


def test_product_without_positive_price_is_dropped(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", product=1, price="0"),
        event("2020-10-05 10:00:01", product=1, price="-3"),
        event("2020-10-05 10:00:02", product=2, price="0"),
        event("2020-10-05 10:00:03", product=2, price="5"),
    )
    assert rows(star.products, "product_id") == [(2,)]
    assert rows(star.events, "product_id", "price") == [(2, Decimal("0.0000")), (2, Decimal("5.0000"))]


def test_latest_positive_price_sets_the_band(spark):
    raw = raw_table(
        spark,
        event("2020-10-05 10:00:00", price="40"),
        event("2020-10-05 11:00:00", price="60"),
        event("2020-10-05 12:00:00", price="0"),
    )
    assert rows(dim_products(product_descriptions(raw)), "price_band") == [("50_to_200",)]


def test_band_edges(spark):
    prices = ["49.9999", "50", "199.9999", "200", "499.9999", "500"]
    raw = raw_table(
        spark,
        *[event("2020-10-05 10:00:00", product=i, price=p) for i, p in enumerate(prices)],
    )
    assert [band for _, band in rows(dim_products(product_descriptions(raw)), "product_id", "price_band")] == [
        "under_50", "50_to_200", "50_to_200", "200_to_500", "200_to_500", "over_500",
    ]


def test_latest_row_without_brand_gives_no_brand(spark):
    raw = raw_table(
        spark,
        event("2020-10-05 10:00:00", brand="acme"),
        event("2020-10-05 11:00:00", brand=None, code=None),
    )
    assert rows(dim_products(product_descriptions(raw)), "brand", "category") == [(None, None)]


def test_latest_row_ties(spark):
    same = "2020-10-05 10:00:00"
    raw = raw_table(
        spark,
        event(same, price="10", brand="z"),
        event(same, price="300", brand=None),
        event(same, price="300", brand="b", code=None),
        event(same, price="300", brand="b", code="home.lamp"),
    )
    assert rows(dim_products(product_descriptions(raw)), "brand", "category", "price_band") == [
        ("b", "home", "200_to_500")
    ]


def test_category_is_the_first_part(spark):
    raw = raw_table(
        spark,
        *[
            event("2020-10-05 10:00:00", product=i, code=c)
            for i, c in enumerate(["a.b.c", "", None, "plain", ".b"])
        ],
    )
    got = [category for _, category in rows(dim_products(product_descriptions(raw)), "product_id", "category")]
    assert got == ["a", None, None, "plain", None]


def test_session_of_two_users_takes_the_smaller(spark):
    raw = raw_table(
        spark,
        event("2020-10-05 10:00:00", user=7),
        event("2020-10-05 10:05:30", user=3, kind="purchase"),
    )
    assert rows(
        fct_sessions(raw), "user_id", "session_duration", "event_count", "converted"
    ) == [(3, timedelta(minutes=5, seconds=30), 2, True)]


def test_cohort_week_starts_monday_utc(spark):
    raw = raw_table(
        spark,
        event("2020-10-04 23:59:59", user=1),
        event("2020-10-05 00:00:00", user=2),
    )
    assert rows(dim_users(raw), "user_id", "cohort_week") == [
        (1, date(2020, 9, 28)),
        (2, date(2020, 10, 5)),
    ]


def test_sunday_is_zero(spark):
    star = star_of(spark, event("2020-10-04 12:00:00"), event("2020-10-05 12:00:00"))
    assert rows(funnel.funnel_by_dow(star), "day_of_week", "viewers") == [(0, 1), (1, 1)]


def test_funnel_stages_are_independent(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", user=1, kind="cart"),
        event("2020-10-05 10:00:00", user=2, kind="purchase"),
        event("2020-10-05 10:00:00", user=3, kind="purchase"),
    )
    got = funnel.funnel_overall(star).first()
    assert (got.viewers, got.cart_adders, got.purchasers) == (0, 1, 2)
    assert got.cart_to_purchase_pct == Decimal("200.00")
    assert got.view_to_cart_pct is None and got.overall_conversion_pct is None


def test_slice_with_other_event_types_only_stays(spark):
    star = star_of(spark, event("2020-10-05 10:00:00", kind="remove_from_cart"))
    assert rows(funnel.funnel_by_price_band(star)) == [("under_50", 0, 0, 0, None, None)]


def test_brand_funnel_uses_the_products_brand_and_threshold(spark):
    events = [event("2020-10-05 10:00:00", user=u, brand="old") for u in range(3)]
    events += [event("2020-10-06 10:00:00", user=9, brand=None)]
    star = star_of(spark, *events, event("2020-10-05 10:00:00", user=1, product=2, brand="solo"))
    assert rows(funnel.funnel_by_brand(star, min_viewers=2), "brand", "viewers") == [
        ("(no brand)", 4)
    ]


@pytest.mark.parametrize(
    "day, expected",
    [(0, (0, 0, 0)), (1, (1, 1, 1)), (7, (1, 1, 1)), (8, (0, 1, 1)), (30, (0, 1, 1)),
     (31, (0, 0, 1)), (60, (0, 0, 1)), (61, (0, 0, 0))],
)
def test_cohort_windows(spark, day, expected):
    bought = at("2020-10-05 12:00:00") + timedelta(days=day)
    star = star_of(
        spark,
        event("2020-10-05 10:00:00"),
        event(str(bought.replace(tzinfo=None)), kind="purchase", session="s2"),
    )
    got = cohorts.cohorts(star).first()
    assert (got.returned_d7, got.returned_d30, got.returned_d60) == expected
    assert got.cohort_size == 1


def test_cohort_return_may_be_the_first_purchase_and_looks_past_day_zero(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", kind="purchase"),
        event("2020-10-05 11:00:00", kind="purchase"),
        event("2020-10-07 09:00:00", kind="purchase"),
        event("2020-10-06 10:00:00", user=2),
    )
    got = cohorts.cohorts(star).first()
    assert (got.cohort_size, got.returned_d7, got.d7_rate_pct) == (2, 1, Decimal("50.00"))


def test_d60_status_edge(spark):
    star = star_of(
        spark,
        event("2020-10-07 10:00:00", user=1),
        event("2020-10-12 10:00:00", user=2),
        event("2020-12-04 10:00:00", user=1, session="s2"),
    )
    assert rows(cohorts.cohort_d60_status(star), "cohort_week", "d60_status") == [
        (date(2020, 10, 5), "complete_d60"),
        (date(2020, 10, 12), "incomplete_d60"),
    ]


def test_activity_counts_the_very_next_event(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", user=1, kind="purchase"),
        event("2020-10-05 11:00:00", user=1),
        event("2020-10-08 10:00:00", user=1),
        event("2020-10-05 09:00:00", user=2),
        event("2020-10-05 10:00:00", user=2, kind="purchase"),
        event("2020-10-08 10:00:00", user=2),
        event("2020-10-05 10:00:00", user=3),
    )
    got = retention.buyer_activity(star).first()
    assert tuple(got) == (2, Decimal("50.00"), Decimal("50.00"), Decimal("50.00"))


def test_two_bands_in_one_first_purchase(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", kind="purchase", product=1, price="10"),
        event("2020-10-05 10:00:00", kind="purchase", product=2, price="600"),
    )
    assert rows(retention.repeat_rates(star)) == [
        ("over_500", 1, 0, Decimal("0.00")),
        ("under_50", 1, 0, Decimal("0.00")),
    ]


def test_repeat_may_come_a_second_later(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", kind="purchase"),
        event("2020-10-05 10:00:01", kind="purchase", price="0"),
        event("2020-10-05 10:00:00", kind="purchase", user=2, price="0"),
        event("2020-10-05 10:00:05", kind="purchase", user=2),
    )
    # The second buyer's first purchase was free, so that buyer is in no band.
    assert rows(retention.repeat_rates(star)) == [("under_50", 1, 1, Decimal("100.00"))]


def test_first_purchase_without_session_leaves_the_buyer_out(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", kind="purchase", session=None),
        event("2020-10-06 10:00:00", kind="purchase"),
    )
    assert rows(retention.repeat_rates(star)) == []
    assert retention.buyer_activity(star).first().first_time_buyers == 1


def test_revenue_counts_paid_purchases(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00", kind="purchase", user=1, price="10.005"),
        event("2020-10-05 10:00:05", kind="purchase", user=1, price="0"),
        event("2020-10-05 10:00:07", kind="purchase", user=2, price="10"),
        event("2020-10-05 10:00:09", kind="purchase", user=2, price="10", code=None, product=2),
        event("2020-10-05 10:00:00", kind="cart", user=3, price="10"),
    )
    assert rows(revenue.arpu_aov_by_band(star)) == [
        ("under_50", 2, Decimal("30.01"), Decimal("15.00"), Decimal("10.00"))
    ]
    assert rows(revenue.arpu_by_category(star), "category", "buyers") == [
        ("(no category)", 1), ("toys", 2),
    ]
    assert rows(overview.overview(star)) == [(3, 2, Decimal("30.01"), 5, 1, 2)]


def test_overview_of_nothing_sold(spark):
    star = star_of(spark, event("2020-10-05 10:00:00"))
    assert rows(overview.overview(star)) == [(1, 0, None, 1, 1, 1)]


def test_labels_fall_back_and_follow_business_order(spark):
    bands = spark.createDataFrame(
        [("over_500", 1), ("odd", 2), ("under_50", 3)], "price_band string, n int"
    )
    got = [tuple(r) for r in shapes.with_band_labels(bands).collect()]
    assert got == [(1, "< $50", "under_50", 3), (4, "> $500", "over_500", 1), (None, "odd", "odd", 2)]


def test_heatmap_matrix(spark):
    star = star_of(
        spark,
        event("2020-10-05 10:00:00"),
        event("2020-10-15 10:00:00", kind="purchase", session="s2"),
        event("2020-10-12 10:00:00", user=2),
    )
    table = cohorts.cohorts(star)
    assert [tuple(r) for r in shapes.cohort_heatmap(table).collect()] == [
        ("7-Day", "2020-10-05=0.00,2020-10-12=0.00"),
        ("30-Day", "2020-10-05=100.00,2020-10-12=0.00"),
        ("60-Day", "2020-10-05=100.00,2020-10-12=0.00"),
    ]
    matrix = shapes.cohort_heatmap_wide(table, ["2020-10-05", "2020-10-12"])
    assert matrix.columns == ["window", "2020-10-05", "2020-10-12"]
    assert [tuple(r) for r in matrix.collect()] == [
        ("7-Day", Decimal("0.00"), Decimal("0.00")),
        ("30-Day", Decimal("100.00"), Decimal("0.00")),
        ("60-Day", Decimal("100.00"), Decimal("0.00")),
    ]


def test_top_categories_drops_the_unnamed_and_orders_by_arpu(spark):
    results = spark.createDataFrame(
        [("(no category)", 99, 9.0), ("a", 30, 3.0), ("b", 20, 1.0), ("c", 10, 2.0)],
        "category string, total_revenue int, arpu double",
    )
    got = [r.category for r in shapes.top_categories(results, limit=2).collect()]
    assert got == ["b", "a"]


def test_top_categories_of_many(spark):
    named = [(f"c{i:02}", i, float(-i)) for i in range(14)]
    results = spark.createDataFrame(named, "category string, total_revenue int, arpu double")
    got = [r.category for r in shapes.top_categories(results).collect()]
    assert got == [f"c{i:02}" for i in range(13, 3, -1)]


def test_constraint_checks_find_planted_faults(spark):
    from cartwright.plans.star import Star

    good = star_of(spark, event("2020-10-05 10:00:00"), event("2020-10-06 10:00:00", user=2))
    tables = {
        "dim_users": good.users.where("user_id = 1"),
        "dim_products": good.products.unionAll(good.products),
        "fct_sessions": good.sessions.selectExpr(
            "session_id", "user_id", "session_start", "session_duration",
            "cast(null as bigint) event_count", "converted",
        ),
        "fct_events": good.events,
    }
    found = quality.constraint_violations(Star(tables.__getitem__)).where("violations > 0")
    assert rows(found) == [
        ("dim_products", "unique product_id", 1),
        ("fct_events", "user_id has parent", 1),
        ("fct_sessions", "event_count not null", 1),
    ]


def test_profile_report_and_empty_raw(spark):
    raw = raw_table(spark, event("2020-10-05 10:00:00"), event("2020-10-05 10:00:00.5", brand=None))
    report = {(r["check"], r["metric"]): r["value"] for r in quality.profile(raw).collect()}
    assert report["null_counts", "null_brand"] == "1"
    assert report["exact_duplicates", "duplicate_groups"] == "0"
    assert report["same_second_duplicates", "rows_to_deduplicate"] == "1"
    assert report["date_range", "max_event_time"] == "2020-10-05 10:00:00.500000"
    assert report["event_types", "view"] == "2"
    with pytest.raises(ValueError, match="empty"):
        quality.profile(raw_table(spark))
