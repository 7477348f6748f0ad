"""Deduplication through the filter of repeated keys, and what it spares."""

import random

import pytest
from cartwright.operators import repeated_keys
from cartwright.operators.first_row import first_row_of_repeated, first_row_per_key
from cartwright.plans import quality, star
from micro import event, raw_table
from pyspark.sql import functions as F


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def table(spark, seed, n=4000, keys=3000, hot=0):
    rng = random.Random(seed)
    rows = [(rng.randrange(keys), rng.randrange(3), rng.randrange(100), i) for i in range(n)]
    rows += [(7, 1, rng.randrange(100), n + i) for i in range(hot)]
    return spark.createDataFrame(rows, "a int, b int, t int, i int").repartition(5)


@pytest.mark.parametrize("size", [1, 4, 64])
@pytest.mark.parametrize("hot", [0, 2000])
def test_same_rows_as_the_plain_way(spark, size, hot):
    rows = table(spark, size, hot=hot)
    keys, order = [F.col("a"), F.col("b")], [F.asc("t"), F.asc("i")]
    seen = repeated_keys.filter_of(repeated_keys.repeated_digests(rows, keys), size)
    got = first_row_of_repeated(rows, keys, order, seen, size).collect()
    assert sorted(got) == sorted(first_row_per_key(rows, keys, order).collect())


def test_no_key_twice_and_no_rows(spark):
    rows = spark.range(500).select(F.col("id").alias("a"), F.lit(1).alias("t"))
    keys, order = [F.col("a")], [F.asc("t")]
    for some in (rows, rows.where("false")):
        digests = repeated_keys.repeated_digests(some, keys)
        assert digests.count() == 0
        seen = repeated_keys.filter_of(digests, 1)
        assert sorted(first_row_of_repeated(some, keys, order, seen, 1).collect()) == sorted(some.collect())


def test_every_repeated_key_is_marked_and_few_others(spark):
    rows = table(spark, 9, n=60_000, keys=200_000)
    keys = [F.col("a"), F.col("b")]
    digests = repeated_keys.repeated_digests(rows, keys)
    size = repeated_keys.filter_rows(digests.count())
    marked = repeated_keys.marked(rows, keys, repeated_keys.filter_of(digests, size), size, "again")
    counted = marked.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("again").alias("all"), F.max("again").alias("any"))
    assert counted.where("n > 1 and not all").isEmpty()
    alone, in_vain = counted.where("n = 1").agg(F.count("*"), F.count_if("any")).first()
    assert alone > 40_000 and in_vain < alone / 10


def test_the_filter_is_bounded():
    assert repeated_keys.filter_rows(0) == 1
    assert repeated_keys.filter_rows(10**6) == 512
    assert repeated_keys.filter_rows(10**15) == repeated_keys.MOST_ROWS


def test_a_saturated_filter_only_costs_time(spark):
    rows = table(spark, 3, n=50_000, keys=8000)
    keys, order = [F.col("a"), F.col("b")], [F.asc("t"), F.asc("i")]
    seen = repeated_keys.filter_of(repeated_keys.repeated_digests(rows, keys), 1)
    got = first_row_of_repeated(rows, keys, order, seen, 1)
    assert got.count() == rows.select("a", "b").distinct().count()


def test_rows_alone_in_their_key_are_neither_sorted_nor_exchanged(spark, tmp_path):
    table(spark, 1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    keys, order = [F.col("a"), F.col("b")], [F.asc("t")]
    repeated_keys.filter_of(repeated_keys.repeated_digests(rows, keys), 2).write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    alone, _, again = plan_of(first_row_of_repeated(rows, keys, order, seen, 2)).partition("WindowGroupLimit")
    first_branch = plan_of(repeated_keys.marked(rows, keys, seen, 2, "again").where("not again"))
    assert "Exchange hashpartitioning" not in first_branch and "Sort " not in first_branch
    assert "BroadcastHashJoin" in first_branch and "hashpartitioning" in again


def test_described_products(spark):
    """The latest priced event counts, then the higher price, then brand and category, missing ones last."""
    rng = random.Random(2)
    events = [
        event(
            f"2020-10-0{rng.randint(1, 3)} 10:00:00", product=rng.randrange(25), brand=rng.choice([None, "a", "b"]),
            code=rng.choice([None, "", "x.y", "z"]), price=rng.choice(["0", "-1", "10", "9.9999", "60", "500", "99999999999999.9999"]),
        )
        for _ in range(600)
    ] + [event("1969-12-31 23:59:59", product=90, price="51", brand=None), event("2020-10-05 10:00:00", product=91, price="0")]
    raw = raw_table(spark, *events)
    want = {}
    for at, _, product, _, code, brand, price, _, _ in events:
        if price > 0:
            key = (-at.timestamp(), -price, brand is None, brand or "", code is None, code or "")
            if product not in want or key < want[product][0]:
                band = "under_50" if price < 50 else "50_to_200" if price < 200 else "200_to_500" if price < 500 else "over_500"
                want[product] = key, (brand, (code or "").split(".")[0] or None, band)
    described = star.product_descriptions(raw)
    got = {r["product_id"]: (r["brand"], r["category"], r["price_band"]) for r in star.dim_products(described).collect()}
    bands = {v[1][2] for v in want.values()}
    assert {p: (b, c) for p, (b, c, _) in got.items()} == {p: v[1][:2] for p, v in want.items()}
    assert len(bands) >= 3 and [got[p][2] == got[q][2] for p in got for q in got] == [
        want[p][1][2] == want[q][1][2] for p in got for q in got
    ]
    unpriced = {r["product_id"] for r in star.unpriced_products(described).collect()}
    assert unpriced == {e[2] for e in events} - set(want) and 91 in unpriced


def test_descriptions_do_not_grow_with_prices(spark):
    raw = raw_table(spark, *[event("2020-10-05 10:00:00", product=i % 3, price=str(i)) for i in range(1, 300)])
    described = star.product_descriptions(raw)
    assert described.count() == 3
    assert "HashAggregate" in plan_of(described) and "SortAggregate" not in plan_of(described)


def test_the_report_looks_again_at_few_seconds_only(spark, tmp_path):
    rng = random.Random(6)
    times = ["10:00:00.1", "10:00:00.1", "10:00:00.2", "10:00:00.3", "10:00:01", "10:00:02"]
    events = [event(f"2020-10-05 {rng.choice(times)}", user=rng.randrange(40), kind=rng.choice(["view", "cart"])) for _ in range(500)]
    raw_table(spark, *events).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    for some in (raw, raw.where("false"), raw.limit(1)):
        got = quality.duplicate_counts(some).first().asDict()
        assert got == quality.exact_duplicates(some).first().asDict() | quality.same_second_duplicates(some).first().asDict()
    assert quality.duplicate_counts(raw).first().duplicate_groups > 10


def test_the_report_has_one_wide_exchange(spark, tmp_path):
    """Both looks at the seconds share it; the second look joins its few seconds by broadcast."""
    events = [event(f"2020-10-05 10:00:00.{f}", user=u) for u in range(50) for f in (1, 1, 2)]
    raw_table(spark, *events).write.parquet(f"{tmp_path}/raw")
    report = quality.profile(spark.read.parquet(f"{tmp_path}/raw"))
    found = {(r["check"], r["metric"]): r["value"] for r in report.collect()}
    assert found["exact_duplicates", "extra_duplicate_rows"] == "50"
    assert found["same_second_duplicates", "rows_to_deduplicate"] == "100"
    plan = plan_of(report).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(user_id" in line and "Reused" not in line]
    by_second = [line for line in wide if "_groupingexpression" in line]
    assert len(by_second) == 1, wide
