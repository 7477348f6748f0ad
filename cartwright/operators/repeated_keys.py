"""Which rows may share their key with another row, by a filter of bounded size.

Keys become 64-bit digests; those met twice set one bit each of a filter. A row whose bit is not set
has a key of its own for certain. A row whose bit is set may have one too, so what follows must
still look at its key; that is exact whatever the filter's size, which only decides how many rows
are looked at in vain.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row of the filter holds so many words of 64 bits, 4 KB.
WORDS = 512
_ROW_BITS = WORDS * 64
#: Bits for each repeated key, so that one row in 16 is looked at in vain at most.
BITS_A_KEY = 16
#: The filter's largest size: 16,384 rows, 64 MB. Beyond it more rows are looked at in vain.
MOST_ROWS = 1 << 14

DIGESTS = T.StructType([T.StructField("digest", T.LongType(), False)])


def digest(keys: list[Column]) -> Column:
    return F.xxhash64(*keys)


def repeated_digests(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """(digest) of the keys that more than one row has. Only digests are shuffled, and each
    map task sends one row a digest, however many rows share the key."""
    return (
        rows.select(digest(keys).alias("digest"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("digest")
    )


def filter_rows(repeated: int) -> int:
    """Rows of a filter for so many repeated keys: a power of two, bounded."""
    rows = 1
    while rows < MOST_ROWS and rows * _ROW_BITS < repeated * BITS_A_KEY:
        rows *= 2
    return rows


def _place(value: Column, size: int) -> tuple[Column, Column, Column]:
    """(row, word, bit) of a digest, from bits of their own."""
    return (
        F.pmod(value, F.lit(size)),
        F.pmod(F.shiftrightunsigned(value, 20), F.lit(WORDS)).cast("int"),
        F.pmod(F.shiftrightunsigned(value, 40), F.lit(64)).cast("int"),
    )


def filter_of(digests: DataFrame, size: int) -> DataFrame:
    """(row, words): the filter as a table of at most ``size`` rows of 4 KB."""
    row, word, bit = _place(F.col("digest"), size)
    words = digests.select(row.alias("row"), word.alias("word"), bit.alias("bit")).groupBy("row", "word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")
    )
    held = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    every = F.sequence(F.lit(0), F.lit(WORDS - 1))
    return held.select(
        "row", F.transform(every, lambda w: F.coalesce(F.col("held")[w], F.lit(0).cast("bigint"))).alias("words")
    )


def marked(rows: DataFrame, keys: list[Column], seen: DataFrame, size: int, name: str) -> DataFrame:
    """The rows with a flag: whether the key may be repeated. ``seen`` comes from ``filter_of`` with
    the same size, which bounds what is broadcast."""
    row, word, bit = _place(digest(keys), size)
    seen = seen.select(F.col("row").alias("_row"), F.col("words").alias("_words"))
    met = rows.withColumn("_place", row).join(F.broadcast(seen), F.col("_place") == F.col("_row"), "left")
    flag = F.coalesce(F.getbit(F.element_at("_words", word + 1), bit) == 1, F.lit(False))
    return met.withColumn(name, flag).drop("_place", "_row", "_words")
