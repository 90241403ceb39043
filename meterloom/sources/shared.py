"""The folder that driver and executors share, and files as tasks reach them."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none and runs on one machine, as in tests, a new
    temporary folder is set for the session. On a cluster that would lose rows,
    so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that what comes before is done once, however often rows are looked at."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_methods(spark: SparkSession) -> None:
    """Has a stage compiled operator by operator where it would be one method of more than 8000 bytes, which the JVM only interprets.

    It is a setting of the session, so jobs make it, not operators; one of the user's own stays.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that the optimizer knows to be empty, so that joins with it cost nothing."""
    return spark.createDataFrame([], schema).where("false")


def opened(path: str) -> tuple:
    """The file system of a path as Hadoop writes it, and the path there, without Spark: for tasks."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))
