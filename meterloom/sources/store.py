"""Records stored by provider and UTC day, and the manifest of files they came from.

A table is Parquet, partitioned by provider and utc_date. Replacing a file's rows
reads and rewrites only the partitions that hold them or will: the kept and the
new rows are written to a staging path beside the table, which is then marked as
whole, and its folders are moved over the old ones. What a writer leaves undone
after that mark the next one does first; what it leaves before, goes. There is
one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import TimeRange, literal
from ..schema import RECORD_TYPES
from .shared import no_rows

STORED_TYPES = RECORD_TYPES | {"file_id": "string", "event_ts": "timestamp", "utc_date": "date"}
COLUMNS = [c for c in STORED_TYPES if c not in ("provider", "utc_date")] + ["provider", "utc_date"]
STORED_SCHEMA = ", ".join(f"{c} {STORED_TYPES[c]}" for c in COLUMNS)
_KEYS = ["provider", "utc_date"]
_MARK = "_WHOLE"
MANIFEST_SCHEMA = "provider string, root_id string, file_id string, path string, fingerprint string, parser_version string, records bigint, days array<date>, min_ts timestamp, max_ts timestamp, models array<string>"


def hashed_id(*parts: F.Column) -> F.Column:
    """24 hex digits that stand for a path: of SHA-256 over the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24)


def pseudonymise(records: DataFrame, root: str) -> DataFrame:
    """Records with ids in place of paths, and without raw rows."""
    provider, path = F.col("provider"), F.col("source_path")
    out = records.withColumns({"root_id": hashed_id(provider, F.lit(root)), "file_id": hashed_id(provider, F.lit(root), path)})
    return out.drop("raw").withColumn("source_path", F.lit(None).cast("string"))


def root_id(provider: str, root: str) -> str:
    """The id that pseudonymise() gives to a root."""
    return hashlib.sha256("\0".join((provider, root)).encode()).hexdigest()[:24]


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """A path in the form in which list_files() gives those below it."""
    fs, p = file_system(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return no_rows(spark, STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def _folder(provider: str | None, day: date | None) -> str:
    """The folder of a partition, as Spark names it."""
    text = [("__HIVE_DEFAULT_PARTITION__" if x is None else str(x)) for x in (provider, day)]
    return f"provider={text[0]}/utc_date={text[1]}"


def in_days(days: Iterable[tuple[str | None, date | None]]) -> F.Column:
    """A filter on partitions alone, so others are not even listed as input."""
    by_provider: dict[str | None, set[date | None]] = {}
    for provider, day in days:
        by_provider.setdefault(provider, set()).add(day)
    out = F.lit(False)
    for provider, of_it in by_provider.items():
        known = sorted(d for d in of_it if d is not None)
        inside = F.col("utc_date").isin(known) if known else F.lit(False)
        inside = inside | F.col("utc_date").isNull() if None in of_it else inside
        out = out | (F.col("provider").eqNullSafe(F.lit(provider)) & inside)
    return out


def days_of(*frames: DataFrame) -> set[tuple[str | None, date | None]]:
    """Partitions (provider, utc_date) of frames. They come to the driver, as their names do in any partitioned write."""
    found: set[tuple[str | None, date | None]] = set()
    for df in frames:
        found |= {(r.provider, r.utc_date) for r in df.select(*_KEYS).distinct().collect()}
    return found


def recover(spark: SparkSession, path: str) -> None:
    """Does what a writer that ended early has left: moves of whole staging paths go on, others are deleted."""
    fs, table = file_system(spark, path.rstrip("/"))
    if not fs.exists(table.getParent()):
        return
    for f in fs.listStatus(table.getParent()):
        if f.getPath().getName().startswith(f"{table.getName()}.staging-"):
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), _MARK)):
                _moved(spark, f.getPath().toString(), path)
            else:
                fs.delete(f.getPath(), True)


def _moved(spark: SparkSession, staged: str, path: str) -> None:
    """Moves the folders of a whole staging path over those of the table; folders without rows now go."""
    fs, mark = file_system(spark, f"{staged}/{_MARK}")
    stream = fs.open(mark)
    folders = json.loads(bytes(stream.readAllBytes()).decode())
    stream.close()
    for name in folders:
        (_, new), (_, old) = file_system(spark, f"{staged}/{name}"), file_system(spark, f"{path}/{name}")
        # A folder that held rows and is no longer there has been moved already.
        if fs.exists(new) or not folders[name]:
            fs.delete(old, True)
        if fs.exists(new):
            fs.mkdirs(old.getParent())
            fs.rename(new, old)
    fs.delete(file_system(spark, staged)[1], True)


def overwrite_days(spark: SparkSession, rows: DataFrame, days: set[tuple[str | None, date | None]], path: str) -> None:
    """Makes rows the content of the partitions in days; all rows must be of these.

    Rows are dealt by day, and a day is split by the bytes that it turns out to
    have, so a large one is the work of many tasks.
    """
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows.select(*COLUMNS).hint("rebalance", *[F.col(k) for k in _KEYS]).write.partitionBy(*_KEYS).parquet(staged)
    fs, _ = file_system(spark, staged)
    folders = {_folder(*d) for d in days}
    held = {f: fs.exists(file_system(spark, f"{staged}/{f}")[1]) for f in sorted(folders)}
    out = fs.create(file_system(spark, f"{staged}/{_MARK}")[1], True)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    _moved(spark, staged, path)


def write_records(records: DataFrame, path: str, touched: DataFrame, days: set[tuple[str | None, date | None]] | None = None) -> None:
    """Stores records; all earlier rows of the touched files (file_id) go, on days that have none now too.

    Ingesting the same files twice leaves the same table. With days, those that
    hold earlier rows of the touched files, no other day is read; without, all
    days' file ids are looked through.
    """
    spark = records.sparkSession
    recover(spark, path)
    touched = touched.select("file_id").distinct()
    stored = read_records(spark, path)
    had = days_of(stored.join(touched, "file_id", "left_semi")) if days is None else days
    wanted = had | days_of(records)
    kept = stored.where(in_days(wanted)).join(touched, "file_id", "left_anti")
    overwrite_days(spark, kept.select(*COLUMNS).unionByName(records.select(*COLUMNS)), wanted, path)


def append_records(records: DataFrame, path: str, before: DataFrame, days: set[tuple[str | None, date | None]] | None = None) -> None:
    """Adds the tail of files that have grown: before has file_id and records, the count so far.

    Stored rows from that ordinal on go first, so adding a tail again changes
    nothing. With days, those that may hold such rows, no other day is read.
    """
    spark = records.sparkSession
    recover(spark, path)
    stored = read_records(spark, path)
    counts = before.select("file_id", F.col("records").alias("_had"))
    tail = stored.join(counts, "file_id").where(F.col("seq") >= F.col("_had"))
    fresh = records.join(counts, "file_id", "left").where(F.col("seq") >= F.coalesce("_had", F.lit(0)))
    wanted = (days_of(tail) if days is None else days) | days_of(fresh)
    kept = stored.where(in_days(wanted)).join(counts, "file_id", "left").where(F.col("_had").isNull() | (F.col("seq") < F.col("_had")))
    overwrite_days(spark, kept.select(*COLUMNS).unionByName(fresh.select(*COLUMNS)), wanted, path)


def removed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of files that are no longer there."""
    return manifest.join(files.select("path"), "path", "left_anti")


def build_manifest(records: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """One row for each file read, those without records too. files has provider, root_id, file_id, path and fingerprint."""
    counts = records.groupBy("file_id").agg(
        F.count("*").alias("records"), F.array_sort(F.collect_set("utc_date")).alias("days"), F.min("event_ts").alias("min_ts"), F.max("event_ts").alias("max_ts"), F.array_sort(F.collect_set("own_model")).alias("models")
    )
    out = files.join(counts, "file_id", "left").withColumns({"records": F.coalesce("records", F.lit(0)), "days": F.coalesce("days", F.array().cast("array<date>")), "models": F.coalesce("models", F.array().cast("array<string>")), "parser_version": F.lit(version)})
    return out.select(*[x.split()[0] for x in MANIFEST_SCHEMA.split(", ")])


def merge_manifest(manifest: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """The manifest with new entries in place of old ones and without removed ones."""
    return manifest.join(new.select("file_id"), "file_id", "left_anti").join(removed.select("file_id"), "file_id", "left_anti").unionByName(new)


def manifest_current(manifest: DataFrame, version: str) -> DataFrame:
    """Entries of this parser version; all others' files are read anew."""
    return manifest.where(F.col("parser_version") == version)


def utc_days(span: TimeRange) -> tuple[date, date]:
    """The first and last UTC day that a range in a local zone touches."""
    return span.start.date(), span.end.date()


def read_range(spark: SparkSession, path: str, span: TimeRange, roots: Sequence[str] | None = None) -> DataFrame:
    """Stored records of a range: partitions by UTC day, then instants exactly, of active roots only."""
    first, last = utc_days(span)
    rows = read_records(spark, path).where(F.col("utc_date").between(F.lit(first), F.lit(last)) & F.col("event_ts").between(literal(span.start), literal(span.end)))
    return rows if roots is None else rows.where(F.col("root_id").isin(*roots))
