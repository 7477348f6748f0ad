"""Whole-table refresh: write a new run folder, then commit it.

A commit is a mark whose name holds a number and the run. No two writers ever write the same mark, so
nothing depends on a store that refuses to create a file twice, as object stores don't. Readers see the
run of the highest mark: of refreshes one after the other the later one, whose number is higher, and of
two that took the same number at the same time the one whose run's name comes last, for every reader
alike. A failed or half-finished refresh stays invisible, a table can be rebuilt from its own previous
version, and clocks don't matter.
"""

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cartwright.sources.files import Files

_COMMITS = "_commits"


class NothingStored(LookupError):
    """No committed run exists below the folder."""


class CommitLost(RuntimeError):
    """The store doesn't show a mark that was just written."""


def new_run(root: str) -> str:
    """A fresh run folder."""
    return f"{root}/run-{uuid.uuid4().hex}"


def _marks(files: Files, root: str) -> list[tuple[int, str]]:
    """(number, run's name) of all commits, in order."""
    parts = (mark.partition(".") for mark in files.names(f"{root}/{_COMMITS}/*.run-*"))
    return sorted((int(number), name) for number, _, name in parts)


def _mark(root: str, number: int, name: str) -> str:
    return f"{root}/{_COMMITS}/{number:012d}.{name}"


def commit(spark: SparkSession, run: str, files: Files | None = None) -> bool:
    """Make a run the newest of its root; whether it is that when the commit is done.

    The mark takes the number after the highest and is then read back among all others. If an
    overlapping refresh has the same number and comes first for readers, or a higher one already, this
    run yields: it counts as committed just before, and False tells so.
    """
    files = files or Files(spark)
    root, _, name = run.rpartition("/")
    marks = _marks(files, root)
    number = marks[-1][0] + 1 if marks else 1
    files.write(_mark(root, number, name), name)
    marks = _marks(files, root)
    if (number, name) not in marks:
        raise CommitLost(f"no mark of {run} after its commit")
    return marks[-1] == (number, name)


def latest_run(spark: SparkSession, root: str) -> str:
    marks = _marks(Files(spark), root)
    if not marks:
        raise NothingStored(f"no committed run below {root}")
    return f"{root}/{marks[-1][1]}"


def is_committed(spark: SparkSession, run: str) -> bool:
    files = Files(spark)
    root, _, name = run.rpartition("/")
    return any(name == marked for _, marked in _marks(files, root)) and files.exists(run)


def prune(spark: SparkSession, root: str, keep: int = 2, abandoned_hours: float = 24) -> None:
    """Remove all but the last ``keep`` committed runs, and runs never committed in which nothing was
    written for long. Two runs let readers of the previous one finish."""
    files = Files(spark)
    marks = _marks(files, root)
    kept = {name for _, name in marks[-keep:]}
    old = {name for _, name in marks[:-keep]} - kept
    before = (time.time() - abandoned_hours * 3600) * 1000
    for name in files.names(f"{root}/run-*"):
        path = f"{root}/{name}"
        if name in old or name not in kept and not files.changed_since(path, before):
            files.delete(path)
    for number, name in marks[:-keep]:
        files.delete(_mark(root, number, name))


#: Bytes of a row group: the least that a scan can give to a task of its own.
ROW_GROUP_BYTES = 8 << 20
#: Stored tables are read several times each; this takes about two thirds of the default's bytes.
COMPRESSION = "zstd"


def write_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", COMPRESSION)
    writer.partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table under its declared schema, with no footer reads for inference."""
    return spark.read.schema(schema).parquet(path).select(schema.names)


def content_version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and last change of a file or folder, without reading it."""
    files = Files(spark)
    return (*files.size(path), files.changed(path))
