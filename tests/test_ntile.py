"""Distributed NTILE against the windowed one."""

import random

import pytest
from micro import rows

from cartwright.operators.ntile import ntile_of_values


def tile_sums(values, tiles):
    """Rows and sum per tile by definition: sort, give the first n mod k tiles one row more."""
    ordered = sorted(values, reverse=True)
    size, larger = divmod(len(ordered), tiles)
    result, start = [], 0
    for tile in range(1, tiles + 1):
        stop = start + size + (tile <= larger)
        if stop > start:
            result.append((tile, stop - start, sum(ordered[start:stop])))
        start = stop
    return result


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 11, 59, 997])
@pytest.mark.parametrize("tiles", [1, 5])
def test_sizes_and_sums(spark, n, tiles):
    rng = random.Random(n * 31 + tiles)
    # One value holds a third of the rows; others repeat a little or not at all.
    values = [500 if i % 3 == 0 else rng.randrange(1000) for i in range(n)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
    got = ntile_of_values(frame, "v", tiles).groupBy("tile").agg({"rows": "sum"})
    per_tile = ntile_of_values(frame, "v", tiles).selectExpr("tile", "rows", "rows * v as total")
    sums = per_tile.groupBy("tile").sum("rows", "total")
    assert rows(sums) == tile_sums(values, tiles)
    assert sum(r[1] for r in rows(got)) == n


def test_many_buckets(spark):
    rng = random.Random(5)
    values = [rng.randrange(3000) for _ in range(20_000)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tiled = ntile_of_values(frame, "v", 7)
        sums = tiled.selectExpr("tile", "rows", "rows * v as total").groupBy("tile").sum("rows", "total")
        assert rows(sums) == tile_sums(values, 7)
        wide = [rng.choice([-1, 1]) * rng.randrange(10**12) for _ in range(3000)]
        frame = spark.createDataFrame([(v,) for v in wide], "v bigint")
        tiled = ntile_of_values(frame, "v", 7)
        sums = tiled.selectExpr("tile", "rows", "rows * v as total").groupBy("tile").sum("rows", "total")
        assert rows(sums) == tile_sums(wide, 7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
