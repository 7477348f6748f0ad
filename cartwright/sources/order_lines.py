"""Raw events derived from order lines, orders and parts.

Each order line becomes a view and, by its flags, a cart and a purchase; some lines also get a
second view within the same second. One scan of the lines feeds all of them.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright import fixed_values as V
from cartwright.schemas import PRICE_TYPE

INPUT_TABLES = ("lineitem", "orders", "part")
_SECOND = 1_000_000


def events_from_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in INPUT_TABLES)
    lines = lines.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus"
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    bought = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")
    # Event type, microseconds after the first view, and the lines it happens on.
    happenings = [
        (V.VIEW, 0, F.lit(True)),
        (V.CART, 60 * _SECOND, F.col("l_returnflag").isin("A", "N")),
        (V.PURCHASE, 120 * _SECOND, bought),
        (V.VIEW, 250_000, F.pmod(order + line, F.lit(50)) == 0),
    ]
    numbers = F.array(*[F.when(happens, F.lit(i)) for i, (_, _, happens) in enumerate(happenings)])

    def by_number(field: int) -> Column:
        return F.element_at(F.array(*[F.lit(h[field]) for h in happenings]), F.col("number") + 1)

    placed = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    first_view = placed + (F.pmod(order * 7919, F.lit(86400)) + line * 600) * _SECOND
    line_price = F.col("l_extendedprice").cast("decimal(14,2)") * F.lit("0.01").cast("decimal(2,2)")
    per_line = joined.select(
        F.explode(numbers).alias("number"),
        first_view.alias("first_view"),
        F.col("l_partkey").alias("product_id"),
        F.col("p_size").cast("bigint").alias("category_id"),
        F.when(
            F.pmod(F.col("p_partkey"), F.lit(5)) != 0,
            F.concat(F.lower("p_type"), F.lit(".size"), F.col("p_size").cast("string")),
        ).alias("category_code"),
        F.when(F.pmod(F.col("p_partkey"), F.lit(4)) != 0, F.lower("p_brand")).alias("brand"),
        F.when(F.pmod(order, F.lit(89)) == 0, F.lit(0).cast(PRICE_TYPE))
        .otherwise(line_price.cast(PRICE_TYPE))
        .alias("price"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.pmod(order, F.lit(97)) != 0, order.cast("string")).alias("user_session"),
    )
    return per_line.where(F.col("number").isNotNull()).select(
        F.timestamp_micros(F.col("first_view") + by_number(1)).alias("event_time"),
        by_number(0).alias("event_type"),
        *V.RAW_COLUMNS[2:],
    )
