"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: Characters that end a word or are stripped from a line: space and \t \n \v \f \r.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Lowers the bytes that are sent to Python at once from Spark's 64 MB, which each core holds on both sides.

    It is a setting of the session, so jobs make it, not operators; one of the user's own stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


def release() -> None:
    """Gives memory that this worker process has freed back to the machine; workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it has no such call


def releasing(run: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """run(batches), with forget() and release() at a task's end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            forget()
            release()

    return wrapped


def trimmed(run: Callable[[pa.Table], pa.Table], least: int = 1 << 20) -> Callable[[pa.Table], pa.Table]:
    """run(table) for a group, with release() after groups of least bytes and more."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= least:
            release()
        return out

    return wrapped


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no frame still in use reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ordered(docs: DataFrame, id_col: str, *tie_breaks: str) -> DataFrame:
    """Rows dealt to partitions by ascending id and sorted there; nulls first.

    Rows with one id may fall into neighbouring partitions, so an id that holds
    a large share of the rows does not fill one task.
    """
    keys = [F.col(id_col).asc_nulls_first(), *[F.xxhash64(F.col(c)).asc() for c in tie_breaks]]
    return docs.repartitionByRange(*keys).sortWithinPartitions(*keys, *tie_breaks)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
