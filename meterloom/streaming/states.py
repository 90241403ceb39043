"""A table of states, one for each file, that batches of a stream add to.

A batch's states are a part of their own, named by its number, so a batch that is
run again writes the same part. The state of a file is that of the last batch
that has one. When parts are many, those before a batch become one; parts that
it covers go, since only the last batch can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.shared import no_rows

#: Parts that are read beside the whole one before they are put together.
_MOST_PARTS = 16


def _parts(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the parts that were written to their end: batch, of a batch alone, and whole, of it and all before."""
    fs, folder = store.file_system(spark, path)
    found: dict[str, list[int]] = {"batch": [], "whole": []}
    if fs.exists(folder):
        for f in fs.listStatus(folder):
            kind, _, number = f.getPath().getName().partition("-")
            if kind in found and store.exists(spark, f"{f.getPath().toString()}/_SUCCESS"):
                found[kind].append(int(number))
    return found


def read_states(spark: SparkSession, path: str, schema: str, before: int | None = None, only: int | None = None) -> DataFrame:
    """The last state of each file from the batches before a number, or those of one batch."""
    if only is not None:
        return spark.read.schema(schema).parquet(f"{path}/batch-{only}")
    parts = _parts(spark, path)
    whole = max((n for n in parts["whole"] if before is None or n < before), default=None)
    later = sorted(n for n in parts["batch"] if (whole is None or n > whole) and (before is None or n < before))
    names = [f"{path}/whole-{whole}"] * (whole is not None) + [f"{path}/batch-{n}" for n in later]
    if not names:
        return no_rows(spark, schema)
    rows = spark.read.schema(schema).parquet(*names)
    if len(names) == 1:
        return rows
    # Lines of a file only grow in number, so the last batch has the last line.
    columns = rows.columns
    return rows.groupBy("source_path").agg(F.max_by(F.struct(*columns), F.struct("line_no", "seq")).alias("s")).select("s.*")


def write_states(rows: DataFrame, path: str, schema: str, number: int) -> None:
    """Writes the part of a batch, after putting earlier parts together where they are many."""
    spark = rows.sparkSession
    parts = _parts(spark, path)
    if len([n for n in parts["batch"] if n < number]) > _MOST_PARTS:
        read_states(spark, path, schema, before=number).write.mode("overwrite").parquet(f"{path}/whole-{number - 1}")
    rows.write.mode("overwrite").parquet(f"{path}/batch-{number}")


def tidy_states(spark: SparkSession, path: str, number: int) -> None:
    """Deletes parts that a whole one before a batch covers."""
    parts = _parts(spark, path)
    whole = max((n for n in parts["whole"] if n < number), default=None)
    if whole is not None:
        fs, _ = store.file_system(spark, path)
        for name in [f"batch-{n}" for n in parts["batch"] if n <= whole] + [f"whole-{n}" for n in parts["whole"] if n < whole]:
            fs.delete(store.file_system(spark, f"{path}/{name}")[1], True)
