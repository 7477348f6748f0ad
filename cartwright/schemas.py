"""Declared schemas of the stored tables."""

from pyspark.sql import types as T

# Four decimals: two would silently round prices such as 31.905.
PRICE_TYPE = T.DecimalType(18, 4)

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("product_id", T.LongType(), False),
        T.StructField("category_id", T.LongType(), False),
        T.StructField("category_code", T.StringType(), True),
        T.StructField("brand", T.StringType(), True),
        T.StructField("price", PRICE_TYPE, False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("user_session", T.StringType(), True),
    ]
)

DIM_PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType(), False),
        T.StructField("brand", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("price_band", T.StringType(), False),
    ]
)

DIM_USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("first_seen", T.TimestampType(), False),
        T.StructField("first_purchase", T.TimestampType(), True),
        T.StructField("cohort_week", T.DateType(), False),
    ]
)

# event_count is a bigint: one hot session may pass 2^31 events.
FCT_SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("session_start", T.TimestampType(), False),
        T.StructField("session_duration", T.DayTimeIntervalType(), False),
        T.StructField("event_count", T.LongType(), False),
        T.StructField("converted", T.BooleanType(), False),
    ]
)

USER_DAYS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("day", T.DateType(), False),
        T.StructField("viewed", T.BooleanType(), False),
        T.StructField("carted", T.BooleanType(), False),
        T.StructField("bought", T.BooleanType(), False),
        T.StructField("events", T.LongType(), False),
        T.StructField("spend", T.DecimalType(28, 4), True),
        T.StructField("last_at", T.TimestampType(), False),
        T.StructField("last_purchase_at", T.TimestampType(), True),
    ]
)

FCT_EVENTS = T.StructType(
    [
        T.StructField(f.name, f.dataType, f.nullable and f.name != "user_session")
        for f in RAW_EVENTS
    ]
)
