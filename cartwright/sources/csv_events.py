"""Load an event CSV into the stored raw table."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright import fixed_values as V
from cartwright.schemas import RAW_EVENTS
from cartwright.sources import store

RAW_TABLE = "raw_events"
_MALFORMED = "_malformed"
_SURPLUS = "_surplus"


def read_event_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The nine raw columns, bound by header name, typed and checked.

    Every column is read as text in header order: Spark binds a user schema by position, which
    would mislabel a reordered file. Other columns are dropped. Null tokens become NULL, and a
    value that does not fit its type, or a missing required one, fails the query. Rows with
    fewer fields than the header are padded with NULL, rows with more fail. Set ``multi_line``
    only for files with line breaks inside quotes; it makes each file one task.
    """
    reader = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    )
    header = reader.csv(path).columns
    _require_columns(header)

    text = (
        reader.option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", _MALFORMED)
        .schema(_all_text([*header, _MALFORMED]))
        .csv(path)
    )
    # Only rows whose field count is off reach the second parse.
    padded = F.from_csv(F.col(_MALFORMED), _all_text([*header, _SURPLUS]), {"escape": '"'})
    surplus = padded[_SURPLUS]
    checked = text.where(
        F.col(_MALFORMED).isNull()
        | surplus.isNull()
        | F.raise_error(F.concat(F.lit("too many fields (line breaks in quotes need multi_line): "), F.col(_MALFORMED))).cast("boolean")
    )
    return checked.select([_typed(field) for field in RAW_EVENTS])


def _require_columns(header: list[str]) -> None:
    """All nine raw columns stand in the header."""
    absent = sorted(set(V.RAW_COLUMNS).difference(header), key=V.RAW_COLUMNS.index)
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in the CSV; its header has {', '.join(header)}")


def _all_text(names: list[str]) -> str:
    quoted = [name.replace("`", "``") for name in names]
    return ", ".join(f"`{name}` string" for name in quoted)


def _typed(field: T.StructField) -> Column:
    raw = F.col(field.name)
    text = F.when(~raw.isin(*V.NULL_TOKENS), raw)
    value = text.try_cast(field.dataType)
    fits = value.isNotNull()
    if field.name == "price":
        # A cast to the stored scale rounds; a price with more decimals must not slip through.
        fits = fits & (value == text.try_cast("decimal(38,18)"))
    if field.nullable:
        fits = fits | text.isNull()
    problem = F.concat(F.lit(f"bad value for {field.name}: "), F.coalesce(raw, F.lit("(empty)")))
    return F.when(fits, value).otherwise(F.raise_error(problem)).alias(field.name)


def load_events(spark: SparkSession, csv_path: str, root: str, multi_line: bool = False) -> int:
    """Replace the raw table below root with a CSV; returns the stored row count."""
    return store_raw(spark, read_event_csv(spark, csv_path, multi_line), root)


def store_raw(spark: SparkSession, events: DataFrame, root: str) -> int:
    """Replace the raw table; the rows are counted while they are written."""
    run = store.new_run(f"{root}/raw")
    written = Observation()
    rows = events.select(*V.RAW_COLUMNS).observe(written, F.count("*").alias("rows"))
    store.write_table(rows, f"{run}/{RAW_TABLE}")
    store.commit(spark, run)
    store.prune(spark, f"{root}/raw")
    count = written.get.get("rows")
    return raw_events(spark, root).count() if count is None else count


def raw_events(spark: SparkSession, root: str) -> DataFrame:
    """The raw table as last loaded."""
    run = store.latest_run(spark, f"{root}/raw")
    return store.read_table(spark, f"{run}/{RAW_TABLE}", RAW_EVENTS)


def raw_bytes(spark: SparkSession, root: str) -> int:
    """Stored bytes of the raw table."""
    return store.content_version(spark, f"{store.latest_run(spark, f'{root}/raw')}/{RAW_TABLE}")[1]
