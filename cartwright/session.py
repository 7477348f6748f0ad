"""Session settings the results depend on, bounds of what a task holds, and the shared working folder."""

import re

from pyspark.sql import SparkSession

#: Compressed bytes that one task reads of stored tables at most, and is dealt by a shuffle. Rows without
#: a twin compress to ten bytes and take seven times that in a hash table, so larger tasks spill.
SCAN_BYTES = 32 << 20
SHUFFLE_BYTES = 16 << 20
#: Stored bytes for each partition of a shuffle, and how many partitions are asked for at most; adaptive
#: execution joins small ones. Tables beyond some 32 GB need the cluster's own number.
DEAL_BYTES = 8 << 20
MOST_PARTITIONS = 1 << 12


def local_session(cores: int | str = "*", app: str = "cartwright", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _bytes(size: str) -> int:
    """Bytes of a setting such as 64MB, 16m or 4096b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def _at_most(spark: SparkSession, key: str, most: int) -> None:
    """Lower a setting in bytes to a bound; smaller ones stay."""
    if _bytes(spark.conf.get(key)) > most:
        spark.conf.set(key, f"{most}b")


def deal(spark: SparkSession, stored: int) -> None:
    """Let shuffles have a partition for every few megabytes of a stored table, so that hash tables
    and sorts don't outgrow a task's memory as the table grows; larger settings stay."""
    wanted = min(-(-stored // DEAL_BYTES), MOST_PARTITIONS)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < wanted:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def prepare(spark: SparkSession) -> SparkSession:
    """Set what right results and skew handling need, and bound what a task holds.

    Event times are UTC, so calendar days, weekdays and weeks must be cut in UTC. Adaptive
    execution splits hot join partitions and picks broadcast joins by measured size. Plain
    microsecond timestamps are smaller than the legacy form and carry file statistics. A few
    open files per task let events be written by type without sorting them by type first; a
    task that meets more types than that sorts the rest. Tasks of some megabytes keep their hash tables
    and sorts in memory, so that nothing is spilled, however large the tables are.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    _at_most(spark, "spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    _at_most(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES)
    return spark


def work_dir(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``, or else from ``setCheckpointDir``. On a cluster
    it has to be one that all executors share.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{context.applicationId}"
