"""Key, reference and null checks, as counts of offending rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nulls_by_column(table: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts of several columns in one scan, as (column_name, violations)."""
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "violations")


def key_checks(parent: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> DataFrame:
    """(check, violations): check 0 has the key values held by more than one row of the parent, check i
    the rows of child i whose value, not null, has no parent.

    Parent and children are told apart by counts in one union, which is summed per value on the map
    side and shuffled once, whatever the number of references; hot values shuffle as one row a task.
    """
    kinds = range(len(children) + 1)

    def tagged(table: DataFrame, column: str, kind: int) -> DataFrame:
        counts = [F.lit(int(k == kind)).cast("bigint").alias(f"n{k}") for k in kinds]
        return table.select(F.col(column).alias("value"), *counts)

    rows = tagged(parent, key, 0)
    for kind, (child, column) in enumerate(children, 1):
        rows = rows.unionAll(tagged(child, column, kind))
    values = rows.groupBy("value").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in kinds])
    without_parent = F.col("value").isNotNull() & (F.col("n0") == 0)
    found = values.agg(
        F.count_if(F.col("n0") > 1).alias("0"),
        *[F.coalesce(F.sum(F.when(without_parent, F.col(f"n{k}"))), F.lit(0)).alias(str(k)) for k in kinds[1:]],
    )
    return found.unpivot([], [str(k) for k in kinds], "check", "violations")
