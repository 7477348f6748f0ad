"""Whole results when one user, product, session and group of copies hold a third of all rows."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import compare
import duckdb
import pandas as pd
import pytest

import oracle_queries
from cartwright.catalog import RAW_PLANS, STAR_PLANS, comparable
from cartwright.fixed_values import RAW_COLUMNS
from cartwright.plans.star import Star, build_star
from cartwright.schemas import RAW_EVENTS

RAW_SQL = f"""
    SELECT {', '.join(RAW_COLUMNS).replace('price', "CAST(price AS DECIMAL(18,4)) AS price")}
    FROM raw_input
"""


def hot_events(n=30_000, seed=11):
    """A third of the rows share user, product and session; a third of those are one copy group."""
    rng = random.Random(seed)
    start = datetime(2020, 9, 24)

    def pick(i):
        hot = i % 3 == 0
        copy = hot and i % 9 == 0
        at = start + timedelta(seconds=rng.randrange(120 * 86400), microseconds=rng.choice([0, 400_000]))
        if copy:
            at = start + timedelta(days=3, microseconds=rng.randrange(1_000_000))
        kind = "view" if copy else rng.choices(["view", "cart", "purchase", "remove"], [6, 3, 3, 1])[0]
        user = 1 if hot else rng.randrange(2, 700)
        product = 1 if hot else rng.randrange(2, 400)
        session = "hot" if hot else rng.choice([None, f"s{rng.randrange(3000)}", f"u{user}"])
        price = Decimal(rng.choice(["9.99", "9.99", "9.99", "60", "250.125", "700", "0", "-1"]))
        if product % 50 == 0:
            price = Decimal(0)
        brand = rng.choice([None, "b%d" % (product % 5)])
        code = rng.choice([None, "", "x%d.y" % (product % 4)])
        return at, kind, product, product % 9, code, brand, price, user, session

    return [pick(i) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    events = hot_events()
    folder = str(tmp_path_factory.mktemp("hot"))
    zoned = [(e[0].replace(tzinfo=timezone.utc), *e[1:]) for e in events]
    spark.createDataFrame(zoned, RAW_EVENTS).repartition(4).write.parquet(f"{folder}/raw")
    raw = spark.read.schema(RAW_EVENTS).parquet(f"{folder}/raw")
    plans = build_star(raw)
    tables = {}
    for name in ("dim_users", "dim_products", "fct_sessions", "fct_events", "user_days"):
        plan = plans._table(name)
        plan.repartition(4).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.schema(plan.schema).parquet(f"{folder}/{name}")
    tables["purchases"] = tables["fct_events"].where("event_type = 'purchase'")

    con = duckdb.connect()
    frame = pd.DataFrame(events, columns=RAW_COLUMNS)
    frame["price"] = frame["price"].astype(str)
    con.register("raw_input", frame)
    return raw, Star(tables.__getitem__), con, oracle_queries.oracle_sql(RAW_SQL)


@pytest.mark.parametrize("name", list(RAW_PLANS) + list(STAR_PLANS))
def test_matches_sql_under_skew(hot, name):
    raw, star, con, sql = hot
    plan = RAW_PLANS[name](raw) if name in RAW_PLANS else STAR_PLANS[name](star)
    assert compare.spark_rows(comparable(plan)) == compare.duck_rows(con, sql[name])


@pytest.fixture
def no_broadcast(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name", ["funnel_by_price_band", "funnel_by_brand", "arpu_aov_by_band", "arpu_by_category",
             "cohorts", "repeat_rates", "buyer_activity", "constraint_violations"]
)
def test_same_rows_without_broadcast(hot, no_broadcast, name):
    _, star, con, sql = hot
    assert compare.spark_rows(comparable(STAR_PLANS[name](star))) == compare.duck_rows(con, sql[name])


def test_hot_product_is_split_in_the_join(hot, no_broadcast):
    _, star, _, _ = hot
    result = STAR_PLANS["funnel_by_price_band"](star)
    result.collect()
    assert "SortMergeJoin(skew=true)" in result._jdf.queryExecution().executedPlan().toString()
