"""NTILE over a whole table without moving the table into one partition."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket spans about a thousandth of its values.
_FINENESS = 1024


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises: at most some 90,000 for 64-bit values."""
    number = value.cast("double")
    return (F.signum(number) * F.floor(F.log1p(F.abs(number)) * _FINENESS)).cast("int")


def ntile_of_values(rows: DataFrame, value: str, tiles: int) -> DataFrame:
    """How many rows of each distinct value fall in each tile, highest value first.

    Returns (value, tile, rows). Equal values are interchangeable within a ranking, so the input
    is first counted per distinct value: a value shared by a third of all rows is one row from
    then on. Ranks are the offset of the value's bucket plus a running count inside it. Buckets
    follow from the values alone, so nothing is sampled or stored.
    """
    counted = rows.groupBy(value).agg(F.count("*").alias("n"))
    bucketed = counted.withColumn("bucket", _bucket(F.col(value)))
    # One row per bucket, so this window is bounded by their number.
    higher_buckets = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .select(
            "bucket",
            F.coalesce(F.sum("in_bucket").over(higher_buckets), F.lit(0)).alias("offset"),
            F.sum("in_bucket").over(Window.partitionBy()).alias("total"),
        )
    )
    higher_values = (
        Window.partitionBy("bucket")
        .orderBy(F.col(value).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        bucketed.withColumn("before", F.coalesce(F.sum("n").over(higher_values), F.lit(0)))
        .join(offsets, "bucket")
        .withColumn("start", F.col("offset") + F.col("before"))
        .withColumn("stop", F.col("start") + F.col("n"))
        .withColumn("size", F.call_function("div", F.col("total"), F.lit(tiles)))
        .withColumn("larger", F.col("total") % tiles)
    )

    # The first `larger` tiles hold size + 1 rows, the others size rows.
    in_larger = F.col("larger") * (F.col("size") + 1)

    def tile_at(rank):
        return F.when(
            rank < in_larger, F.call_function("div", rank, F.col("size") + 1) + 1
        ).otherwise(
            F.call_function("div", rank - in_larger, F.nullif(F.col("size"), F.lit(0)))
            + F.col("larger")
            + 1
        )

    def tile_start(tile):
        return (tile - 1) * F.col("size") + F.least(tile - 1, F.col("larger"))

    tile = F.col("tile")
    share = F.least(F.col("stop"), tile_start(tile + 1)) - F.greatest(
        F.col("start"), tile_start(tile)
    )
    spanned = F.sequence(tile_at(F.col("start")), tile_at(F.col("stop") - 1))
    return placed.withColumn("tile", F.explode(spanned)).select(
        value, tile.cast("int").alias("tile"), share.alias("rows")
    )
