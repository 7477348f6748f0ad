"""Names, labels, thresholds and tokens that results must match exactly."""

# Raw event columns, in stored order.
RAW_COLUMNS = (
    "event_time",
    "event_type",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
    "user_id",
    "user_session",
)

# Raw columns that may be empty; every other raw column must hold a value.
OPTIONAL_RAW_COLUMNS = ("category_code", "brand", "user_session")

# CSV texts that mean "no value".
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

VIEW = "view"
CART = "cart"
PURCHASE = "purchase"

# Price bands: exclusive upper bound, name. The last band is open.
PRICE_BANDS = (
    (50, "under_50"),
    (200, "50_to_200"),
    (500, "200_to_500"),
    (None, "over_500"),
)
PRICE_BAND_LABELS = {
    "under_50": "< $50",
    "50_to_200": "$50–$200",
    "200_to_500": "$200–$500",
    "over_500": "> $500",
}

# Weekday 0 is Sunday.
WEEKDAY_LABELS = {0: "Sun", 1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat"}

QUINTILE_LABELS = {1: "Top 20%", 2: "2nd 20%", 3: "3rd 20%", 4: "4th 20%", 5: "Bottom 20%"}

FUNNEL_STAGE_LABELS = {
    "viewers": "Viewed a product",
    "cart_adders": "Added to cart",
    "purchasers": "Purchased",
}

# Retention windows in days, with the label of each rate.
WINDOW_DAYS = (7, 30, 60)
WINDOW_LABELS = {7: "7-Day", 30: "30-Day", 60: "60-Day"}

NO_BRAND = "(no brand)"
NO_CATEGORY = "(no category)"

COMPLETE_D60 = "complete_d60"
INCOMPLETE_D60 = "incomplete_d60"

# Column headings of the display tables.
COHORT_HEADINGS = {
    "cohort_week": "Cohort Week",
    "cohort_size": "Size",
    "returned_d7": "Back in 7d",
    "d7_rate_pct": "7-Day %",
    "returned_d30": "Back in 30d",
    "d30_rate_pct": "30-Day %",
    "returned_d60": "Back in 60d",
    "d60_rate_pct": "60-Day %",
}
REPEAT_HEADINGS = {
    "label": "Band",
    "first_time_buyers": "1st-time",
    "returned_buyers": "Returned",
    "repeat_rate_pct": "Rate %",
}
QUINTILE_HEADINGS = {
    "label": "Segment",
    "users": "Users",
    "revenue": "Revenue ($)",
    "revenue_pct": "Share %",
}
