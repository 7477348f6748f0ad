"""Display labels and the business order of labelled values."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(value: Column, names: dict) -> Column:
    """The display name of a value, or the value itself when it has none."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(lookup, value), value.cast("string"))


def position(value: Column, names: dict) -> Column:
    """1-based place of a value in the business order; NULL for an unlisted one."""
    order = F.array(*[F.lit(x) for x in names])
    return F.nullif(F.array_position(order, value), F.lit(0).cast("bigint")).cast("int")
