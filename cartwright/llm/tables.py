"""Results that are read more than once, as tables in the shared checkpoint folder."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.sources.files import Files


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``, or else below that of ``setCheckpointDir``.

    Only where both are missing, as in a local test, is a temporary folder used; a cluster
    has to name one that the driver and all executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_folder()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows written as a table and read back: lost executors cost no recomputation from the
    start, and reruns of later steps see the very same rows."""
    path = f"{shared_folder(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Scratch:
    """Tables that only the making of one result needs; they go when it is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, shared_folder(spark), 0

    def stored(self, rows: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def remove(self) -> None:
        Files(self.spark).delete(self.folder)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from which numbers of partitions are derived."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
