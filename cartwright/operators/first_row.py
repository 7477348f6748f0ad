"""One row per key: the first under an order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwright.operators import repeated_keys


def first_row_per_key(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Keep the first row of every key.

    Catalyst turns ``row_number() = 1`` into a group limit on both sides of the exchange: every
    map task sends at most one row per key, so a key repeated in a third of all rows still
    reaches its reducer as one row per map task.
    """
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_place") == 1).drop("_place")


def first_row_of_repeated(
    rows: DataFrame, keys: list[Column], order: list[Column], seen: DataFrame, size: int
) -> DataFrame:
    """The same rows, but only those whose key may be repeated are sorted and exchanged.

    ``seen`` is the filter of the repeated keys and ``size`` its size (``repeated_keys``). All other
    rows are the only ones of their key and pass as they are; they are read once more for it.
    """
    flagged = repeated_keys.marked(rows, keys, seen, size, "_repeated")
    alone = flagged.where(~F.col("_repeated")).drop("_repeated")
    return alone.unionAll(first_row_per_key(flagged.where("_repeated").drop("_repeated"), keys, order))
