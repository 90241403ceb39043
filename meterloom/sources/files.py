"""Files of a root and which of them have to be read."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import folders_above
from ..functions.timez import TimeRange, literal
from ..operators.filters import spans_overlap
from .shared import new_path, opened

FILES_SCHEMA = "path string, name string, size bigint, modified_at timestamp"
#: Files of an event table: a folder of Parquet files called session.db.
EVENT_PART = r"/session\.db/[^/]+\.parquet$"
#: Which file names each family of logs reads.
NAME_RULES = {p: r"(?i)(?<!\.meta)\.jsonl?$" for p in ("claude", "codex", "pi")} | {"grok": r"^(?:updates\.jsonl|session\.db)$"}


def list_files(spark: SparkSession, root: str, name_filter: str = NAME_RULES["claude"]) -> DataFrame:
    """All files below root whose names match, hidden and empty ones too, by a listing of metadata alone.

    Spark's own readers leave out names that begin with _ or a dot. An
    unreadable or missing root gives no row.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    rows = []
    if fs.exists(path):
        found = fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            rows.append((f.getPath().toString(), f.getPath().getName(), f.getLen(), f.getModificationTime()))
    files = spark.createDataFrame(rows, "path string, name string, size bigint, ms bigint")
    return files.where(F.col("name").rlike(name_filter)).select("path", "name", "size", F.timestamp_millis("ms").alias("modified_at"))


_LISTED = "path string, name string, size bigint, ms bigint, folder boolean"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in folders; one that is missing or can't be read holds nothing."""
    import pyarrow.fs as pafs

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            fs, local = opened(folder)
            try:
                found = fs.get_file_info(pafs.FileSelector(local, allow_not_found=True))
            except OSError:
                continue
            rows = [{"path": f"{folder}/{f.base_name}", "name": f.base_name, "size": f.size, "ms": f.mtime_ns and f.mtime_ns // 1_000_000, "folder": f.type == pafs.FileType.Directory} for f in found]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("ms", pa.int64()), ("folder", pa.bool_())]))


def list_tree(spark: SparkSession, root: str, name_filter: str = NAME_RULES["claude"]) -> DataFrame:
    """What list_files() gives, listed by tasks, level by level of folders, for roots of very many files.

    Each level is a table in the shared folder, so no list comes to the driver.
    root must be of a file system that pyarrow reaches from the tasks.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, level, depth = new_path(spark, "listing"), spark.createDataFrame([(fs.makeQualified(path).toString(),)], "path string"), 0
    while not level.isEmpty():
        # Folders are dealt anew, as one may hold most of a level's.
        level.repartition("path").mapInArrow(_listed, _LISTED).write.parquet(f"{base}/{depth}")
        level = spark.read.schema(_LISTED).parquet(f"{base}/{depth}").where("folder").select("path")
        depth += 1
    rows = spark.read.schema(_LISTED).parquet(*[f"{base}/{i}" for i in range(depth)]).where("NOT folder")
    return rows.where(F.col("name").rlike(name_filter)).select("path", "name", "size", F.timestamp_millis("ms").alias("modified_at"))


def of_event_table() -> Column:
    """Whether a file is an event table or a part of one; neither is text."""
    return F.col("path").rlike(EVENT_PART) | (F.col("name") == "session.db")


def only_event_tables(files: DataFrame) -> DataFrame:
    """Of directories that hold a session.db, that file or folder alone."""
    # A table is a file, or a folder with files of its own.
    parent = F.when(F.col("path").rlike(EVENT_PART), F.regexp_replace("path", r"/session\.db/[^/]*$", "")).otherwise(F.regexp_replace("path", r"/[^/]*$", ""))
    rows = files.withColumn("_dir", parent)
    tables = rows.where(of_event_table()).select("_dir").distinct()
    return rows.where(of_event_table()).unionByName(rows.where(~of_event_table()).join(tables, "_dir", "left_anti")).drop("_dir")


def turn_log_files(files: DataFrame) -> DataFrame:
    """Of a listing of all names: logs of turns and event tables."""
    return only_event_tables(files.where(F.col("name").rlike(NAME_RULES["grok"]) | F.col("path").rlike(EVENT_PART)))


def child_folders(files: DataFrame, logs: DataFrame) -> DataFrame:
    """child and meta (the path of its meta.json, or null) of each folder in subagents of a session that has a log.

    files is a listing of all names, logs those of them that are read.
    """
    part = lambda i: F.regexp_extract("path", r"^(.*)/subagents/([^/]+)/", i)
    meta = F.when(F.col("path").rlike(r"/subagents/[^/]+/meta\.json$"), F.col("path"))
    found = files.select(part(1).alias("_session"), part(2).alias("child"), meta.alias("meta")).where("child <> ''")
    parents = logs.select(F.regexp_replace("path", r"/[^/]*$", "").alias("_session")).distinct()
    return found.join(parents, "_session", "left_semi").groupBy("_session", "child").agg(F.max("meta").alias("meta")).drop("_session")


def path_date(path: Column) -> Column:
    """The first date in a path that is written as directories of year, month and day."""
    part = lambda i: F.regexp_extract(path, r"(?:^|[/\\])(\d{4})[/\\](\d{2})[/\\](\d{2})(?:[/\\]|$)", i)
    return F.to_date(F.try_to_timestamp(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("--"))))


def prune_files(files: DataFrame, span: TimeRange, provider: str) -> DataFrame:
    """Adds skip_reason where a file's path or age says that it can't hold records of a range; null where it may."""
    day = timedelta(days=1)
    dated = path_date(F.col("path"))
    reason = F.when(dated > F.to_date(literal(span.end + day)), "after_range").when(F.col("modified_at") < literal(span.start - day), "not_modified_since")
    if provider != "codex":
        # Counter logs go on for days in the file of the day on which they began.
        reason = reason.when(dated < F.to_date(literal(span.start - day)), "before_range")
    return files.withColumn("skip_reason", reason)


def fingerprint(files: DataFrame) -> Column:
    return F.concat_ws(":", F.col("size"), F.unix_millis("modified_at"))


def files_to_ingest(files: DataFrame, manifest: DataFrame, span: TimeRange | None, provider: str, version: str, force: bool = False) -> DataFrame:
    """Adds action: reuse, skip or ingest.

    Files with a current entry and an unchanged fingerprint are not read again;
    outside the range by their entry's instants they are skipped, as are new
    files that prune_files() rules out.
    """
    entry = manifest.where((F.col("provider") == provider) & (F.col("parser_version") == version)).select(F.col("path"), F.col("fingerprint").alias("_known"), F.col("min_ts").alias("_min"), F.col("max_ts").alias("_max"))
    rows = (prune_files(files, span, provider) if span else files.withColumn("skip_reason", F.lit(None).cast("string"))).withColumn("fingerprint", fingerprint(files))
    joined = rows.join(entry, "path", "left")
    same = F.col("_known").eqNullSafe(F.col("fingerprint")) & F.col("_known").isNotNull()
    inside = F.lit(True) if span is None else F.coalesce(spans_overlap(F.col("_min"), F.col("_max"), literal(span.start), literal(span.end)), F.lit(True))
    action = F.when(F.lit(force), "ingest").when(same & inside, "reuse").when(same, "skip").when(F.col("_known").isNull() & F.col("skip_reason").isNotNull(), "skip").otherwise("ingest")
    return joined.withColumn("action", action).drop("_known", "_min", "_max")


def detect_sources(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """provider, source_path and files: the first candidate root of each provider that holds files.

    candidates has provider, root, priority and name_filter, a row for each
    place to look at. Files meet roots by the folders above them.
    """
    roots = candidates.withColumn("_root", F.regexp_replace("root", "/+$", ""))
    above = files.select("name", F.explode(folders_above(F.col("path"))).alias("_root"))
    found = above.join(roots, "_root").where(F.rlike("name", F.col("name_filter"))).groupBy("provider", "root", "priority").agg(F.count("*").alias("files"))
    first = Window.partitionBy("provider").orderBy("priority", "root")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("provider", F.col("root").alias("source_path"), "files")
