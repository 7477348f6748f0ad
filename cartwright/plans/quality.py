"""Audit of the raw events and of the star's keys."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright import schemas
from cartwright.functions import events as E
from cartwright.operators import constraints
from cartwright.plans.star import Star

_EVENT_KEYS = ("user_id", "product_id", "event_type")


def _null_counts():
    return [
        F.count("*").alias("total_rows"),
        *[(F.count("*") - F.count(c)).alias(f"null_{c}") for c in V.RAW_COLUMNS],
    ]


def _price_counts():
    return [
        F.count_if(F.col("price") == 0).alias("zero_price_rows"),
        F.count_if(F.col("price") < 0).alias("negative_price_rows"),
    ]


def _time_bounds():
    return [
        F.min("event_time").alias("min_event_time"),
        F.max("event_time").alias("max_event_time"),
    ]


def null_counts(raw: DataFrame) -> DataFrame:
    return raw.agg(*_null_counts())


def price_anomalies(raw: DataFrame) -> DataFrame:
    return raw.agg(*_price_counts())


def date_range(raw: DataFrame) -> DataFrame:
    return raw.agg(*_time_bounds())


def _repeats(raw: DataFrame, instant, extra_rows: str, groups: str) -> DataFrame:
    repeated = (
        raw.groupBy(*_EVENT_KEYS, instant.alias("instant"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    return repeated.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(extra_rows),
        F.count("*").alias(groups),
    )


def exact_duplicates(raw: DataFrame) -> DataFrame:
    """Same user, product, type and timestamp."""
    return _repeats(raw, F.col("event_time"), "extra_duplicate_rows", "duplicate_groups")


def same_second_duplicates(raw: DataFrame) -> DataFrame:
    """Same user, product, type and calendar second."""
    second = E.second_bucket(F.col("event_time"))
    return _repeats(raw, second, "rows_to_deduplicate", "bucket_count")


def _by_second(raw: DataFrame) -> DataFrame:
    """Events of each key and second: how many, the first time and the last."""
    at = F.col("event_time")
    return raw.groupBy(*_EVENT_KEYS, E.second_bucket(at).alias("instant")).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")
    )


def duplicate_counts(raw: DataFrame) -> DataFrame:
    """The figures of ``exact_duplicates`` and ``same_second_duplicates`` in one row, from one wide exchange.

    In a second whose events have one time all of them are exact duplicates, and of two events at two
    times none is. Only seconds of three and more events at several times are looked at again, event
    by event.
    """
    several = _by_second(raw).where(F.col("n") > 1)
    one_time = F.col("first") == F.col("last")

    def extra(n: Column) -> Column:
        return F.coalesce(F.sum(n - 1), F.lit(0))

    counted = several.agg(
        extra(F.when(one_time, F.col("n"))).alias("extra_duplicate_rows"),
        F.count_if(one_time).alias("duplicate_groups"),
        extra(F.col("n")).alias("rows_to_deduplicate"),
        F.count("*").alias("bucket_count"),
    )
    open_ = several.where((F.col("n") > 2) & ~one_time).select(
        *[F.col(k).alias(f"open_{k}") for k in _EVENT_KEYS], F.col("instant").alias("open_instant")
    )
    # null-safe, as a plain join would filter one of the two readings and so keep them from sharing
    second = E.second_bucket(F.col("event_time"))
    same = [F.col(k).eqNullSafe(F.col(f"open_{k}")) for k in _EVENT_KEYS]
    again = raw.select(*_EVENT_KEYS, "event_time").join(
        open_, reduce(Column.__and__, [*same, second.eqNullSafe(F.col("open_instant"))]), "left_semi"
    )
    mixed = again.groupBy(*_EVENT_KEYS, "event_time").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    none = F.lit(0).cast("bigint")
    parts = counted.unionAll(mixed.agg(extra(F.col("n")), F.count("*"), none, none))
    return parts.agg(*[F.sum(c).alias(c) for c in counted.columns])


def midnight_sessions(raw: DataFrame) -> DataFrame:
    """Sessions with events on two dates; session-less events count as one session."""
    spans = raw.groupBy("user_session").agg(
        F.to_date(F.min("event_time")).alias("first_day"),
        F.to_date(F.max("event_time")).alias("last_day"),
    )
    return spans.agg(
        F.count_if(F.col("first_day") != F.col("last_day")).alias("midnight_spanning_sessions")
    )


def event_types(raw: DataFrame) -> DataFrame:
    return (
        raw.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")
    )


def profile(raw: DataFrame) -> DataFrame:
    """Every raw check as (check, metric, value); nulls, prices and dates share one scan."""
    if raw.isEmpty():
        raise ValueError("raw_events is empty; load a CSV first")

    def check_of_scan(metric: Column) -> Column:
        return (
            F.when(metric.endswith("_price_rows"), "price_anomalies")
            .when(metric.isin("min_event_time", "max_event_time"), "date_range")
            .otherwise("null_counts")
        )

    def check_of_duplicates(metric: Column) -> Column:
        exact = metric.isin("extra_duplicate_rows", "duplicate_groups")
        return F.when(exact, "exact_duplicates").otherwise("same_second_duplicates")

    def melted(result: DataFrame, check_of: Callable[[Column], Column]) -> DataFrame:
        names = result.columns
        texts = result.select(*[F.col(n).cast("string").alias(n) for n in names])
        long = texts.unpivot([], names, "metric", "value")
        return long.select(check_of(F.col("metric")).alias("check"), "metric", "value")

    def named(check: str) -> Callable[[Column], Column]:
        return lambda metric: F.lit(check)

    one_scan = raw.agg(*_null_counts(), *_price_counts(), *_time_bounds()).withColumns(
        {
            name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            for name in ("min_event_time", "max_event_time")
        }
    )
    types = event_types(raw).select(
        F.lit("event_types").alias("check"),
        F.col("event_type").alias("metric"),
        F.col("n").cast("string").alias("value"),
    )
    parts = [
        melted(one_scan, check_of_scan),
        melted(duplicate_counts(raw), check_of_duplicates),
        melted(midnight_sessions(raw), named("midnight_sessions")),
        types,
    ]
    return reduce(DataFrame.unionAll, parts)


def constraint_violations(star: Star) -> DataFrame:
    """Offending rows per key, reference and required column, as (table_name, rule, violations).

    Users, products and sessions are shuffled once each, with all that refers to them.
    """
    keys = [
        ("dim_users", star.users, "user_id", [
            ("fct_sessions", star.sessions, "user_id"), ("fct_events", star.events, "user_id"),
        ]),
        ("dim_products", star.products, "product_id", [("fct_events", star.events, "product_id")]),
        ("fct_sessions", star.sessions, "session_id", [("fct_events", star.events, "user_session")]),
    ]
    required = [
        ("dim_users", star.users, schemas.DIM_USERS),
        ("dim_products", star.products, schemas.DIM_PRODUCTS),
        ("fct_sessions", star.sessions, schemas.FCT_SESSIONS),
        ("fct_events", star.events, schemas.FCT_EVENTS),
    ]

    def chosen(texts: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, texts)), F.col("check").cast("int") + 1)

    parts = []
    for table, frame, key, references in keys:
        checks = constraints.key_checks(frame, key, [(child, column) for _, child, column in references])
        rules = [f"unique {key}", *[f"{column} has parent" for _, _, column in references]]
        parts.append(
            checks.select(
                chosen([table, *[name for name, _, _ in references]]).alias("table_name"),
                chosen(rules).alias("rule"), "violations",
            )
        )
    for table, frame, schema in required:
        counts = constraints.nulls_by_column(frame, [f.name for f in schema if not f.nullable])
        rule = F.concat(F.col("column_name"), F.lit(" not null"))
        parts.append(counts.select(F.lit(table).alias("table_name"), rule.alias("rule"), "violations"))
    return reduce(DataFrame.unionAll, parts)
