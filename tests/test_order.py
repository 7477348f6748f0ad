"""Results that are sorted come in their order."""

import pytest

from cartwright.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def _falling(name):
    return lambda row: -row[name]


ORDERS = {
    "profile_event_types": lambda r: (-r["n"], r["event_type"]),
    "funnel_by_price_band": _falling("viewers"),
    "funnel_by_brand": lambda r: (
        r["cart_to_purchase_pct"] is None, r["cart_to_purchase_pct"] or 0, -r["viewers"]
    ),
    "funnel_by_dow": lambda r: r["day_of_week"],
    "cohorts": lambda r: r["cohort_week"],
    "cohort_d60_status": lambda r: r["cohort_week"],
    "repeat_rates": _falling("repeat_rate_pct"),
    "arpu_by_price_band": _falling("arpu"),
    "arpu_by_category": _falling("total_revenue"),
    "aov_by_price_band": _falling("aov"),
    "arpu_aov_by_band": _falling("arpu"),
    "quintiles": lambda r: r["quintile"],
    "bands_labelled": lambda r: r["band_order"],
    "funnel_long": lambda r: r["stage_order"],
    "cohort_heatmap": lambda r: ["7-Day", "30-Day", "60-Day"].index(r["window"]),
    "top_categories": lambda r: (r["arpu"], r["category"]),
}


@pytest.mark.parametrize("name", list(ORDERS))
def test_rows_are_in_order(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert rows == sorted(rows, key=ORDERS[name])
