"""Log files as numbered lines and JSON documents as rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.variants import is_object
from .shared import opened

LINES_SCHEMA = "source_path string, line_no bigint, value string"
#: Bytes of a part of a hidden file, which one task reads; lines that are handed on at once.
RANGE_BYTES, _ROWS = 32 << 20, 5000
#: Lines of a packed file that stay together when they are dealt to tasks.
DEALT_LINES = 10_000
_PACKED = r"(?i)\.(?:gz|bz2|lz4|zst)$"
#: Names that Spark's readers leave out.
_HIDDEN = r"^[_.]"


def _parts(files: DataFrame, range_bytes: int) -> DataFrame:
    """path, start and end of the parts of hidden files, by a table: paths don't come to the driver. Packed files are one part."""
    rows = files.where(F.col("name").rlike(_HIDDEN) & (F.col("size") > 0))
    step = F.when(F.col("name").rlike(_PACKED), F.col("size")).otherwise(F.lit(range_bytes)).cast("bigint")
    starts = rows.select("path", "size", step.alias("step")).select("path", "size", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("step"))).alias("start"))
    parts = starts.select("path", "start", F.least(F.col("start") + F.col("step"), F.col("size")).alias("end"), (F.col("step") == F.col("size")).alias("whole"))
    return parts.repartition("path", "start")


def _lines_in(path: str, start: int, end: int, whole: bool) -> Iterator[str]:
    """The lines that begin in a part of a file, as far as they go. A file that can't be read gives none."""
    try:
        fs, local = opened(path)
        with fs.open_input_stream(local) if whole else fs.open_input_file(local) as raw, io.BufferedReader(raw, 1 << 20) as f:
            if start:
                f.seek(start - 1)
                start += len(f.readline()) - 1
            while whole or start < end:
                line = f.readline()
                if not line:
                    break
                start += len(line)
                yield line.removesuffix(b"\n").decode("utf-8", "replace")
    except (OSError, EOFError, ValueError):
        return


def scan_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """source_path, line_no (from 1) and value of each line of files (of list_files()).

    Lines end at \\n; one \\r before it is dropped; blank lines count; a last line
    without an end counts. Splits of a large file are read in parallel; a line's
    number is its place in its split and the lines of the splits before, so texts
    are neither sorted nor shuffled, but the files are read twice, first to count.
    A packed file is one split: its lines are dealt to many tasks once they are
    numbered. A file that can't be read gives no line.
    """
    shown = files.where(~F.col("name").rlike(_HIDDEN) & (F.col("size") > 0)).select("path", F.col("name").rlike(_PACKED).alias("packed"))
    paths: dict[bool, list[str]] = {False: [], True: []}
    for r in shown.toLocalIterator():
        paths[r.packed].append(r.path)
    out = hidden_lines(files)
    if paths[False]:
        out = out.unionByName(_shown_lines(spark, paths[False]))
    if paths[True]:
        out = out.unionByName(_shown_lines(spark, paths[True]).repartition("source_path", F.floor(F.col("line_no") / DEALT_LINES)))
    return out.withColumn("value", F.regexp_replace("value", "\r$", ""))


def _shown_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.options(lineSep="\n", ignoreCorruptFiles=True, ignoreMissingFiles=True).text(paths)
    # A split's rows follow each other in one partition, so their ids do.
    rows = raw.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    return _numbered(rows, few=True)


def _numbered(rows: DataFrame, few: bool = False) -> DataFrame:
    """Lines in LINES_SCHEMA from rows with source_path, _block and _id, which rises by one in a block.

    With few, where the driver holds the list of files anyway, counts of splits go to every task and texts stay where they are read.
    """
    splits = rows.groupBy("source_path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    splits = F.broadcast(splits) if few else splits
    return rows.join(splits, ["source_path", "_block"]).select("source_path", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value")


def hidden_lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of files whose names Spark's readers leave out, read by parts of range_bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                held, n = [], 0
                for line in _lines_in(**part):
                    held.append(line)
                    if len(held) == _ROWS:
                        yield _batch(part, n, held)
                        n, held = n + len(held), []
                if held:
                    yield _batch(part, n, held)

    return _numbered(_parts(files, range_bytes).mapInArrow(read, "source_path string, _block bigint, _id bigint, value string"))


def _batch(part: dict, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    columns = [pa.array([part["path"]] * n, pa.string()), pa.array([part["start"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["source_path", "_block", "_id", "value"])


def whole_texts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """source_path and value of whole files, hidden ones too; a file that can't be read gives no row. A file is a task's unit of work.

    Tasks read them from the table of paths, so no list comes to the driver, however many there are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    fs, local = opened(path)
                    with fs.open_input_stream(local) as f:
                        text = f.read().decode("utf-8", "replace")
                except (OSError, EOFError, ValueError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], names=["source_path", "value"])

    return files.where(F.col("size") > 0).select("path").repartition("path").mapInArrow(read, "source_path string, value string")


def scan_json_docs(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (source_path, line_no, v VARIANT) of whole-document JSON files, and the paths of files that are no JSON.

    The rows are the document if it is an array, else its records, messages or
    entries, else the document itself. A document is a task's unit of work.
    """
    texts = whole_texts(spark, files)
    docs = texts.withColumn("doc", F.try_parse_json("value"))
    kind = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    doc = F.col("doc")
    inner = [F.try_variant_get(doc, f"$.{k}", "variant") for k in ("records", "messages", "entries")]
    array = F.when(kind(doc), F.try_variant_get(doc, "$", "array<variant>"))
    for x in inner:
        array = F.coalesce(array, F.when(is_object(doc) & kind(x), F.try_variant_get(x, "$", "array<variant>")))
    rows = docs.where(doc.isNotNull()).select("source_path", F.posexplode(F.coalesce(array, F.array(doc))).alias("pos", "v"))
    return rows.select("source_path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "v"), docs.where(doc.isNull()).select("source_path")
