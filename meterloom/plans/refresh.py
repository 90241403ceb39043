"""From roots of log files to stored records, again and again.

A refresh lists the roots, reads the files that are new or changed, replaces
their rows in the store, drops the rows of files that are gone, and writes the
manifest anew. Files that can't be read keep their rows and their entry, so the
next refresh tries them again. Rows are written before the manifest: a refresh
that ends between the two is made good by the next one. Beside records, manifest
and the last refresh's report nothing stays behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import TimeRange
from ..operators import ingest, quality
from ..schema import ISSUE_SCHEMA
from ..sources import files, lines, store

#: Entries of another version are read anew.
PARSER_VERSION = "1.1"
ACTIONS_SCHEMA = "path string, name string, size bigint, modified_at timestamp, skip_reason string, fingerprint string, action string, provider string, source_path string"


@dataclass(frozen=True)
class Root:
    """A folder with logs of one provider. Names are matched by name_filter, else by the provider's rule. With by_tasks its folders are listed by tasks."""

    provider: str
    path: str
    name_filter: str | None = None
    by_tasks: bool = False


@dataclass
class Refreshed:
    """What a refresh did. records are those of the range, read back from the store."""

    records: DataFrame
    manifest: DataFrame
    actions: DataFrame
    coverage: DataFrame
    status: DataFrame
    issues: DataFrame


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole manifest under path; none gives an empty one."""
    return _read_newest(spark, path, store.MANIFEST_SCHEMA)


def _read_newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    newest = _newest(spark, path)
    return spark.read.schema(schema).parquet(newest[1]) if newest else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the last generation that was written to its end."""
    fs, folder = store.file_system(spark, path)
    if not fs.exists(folder):
        return None
    found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("generation-")]
    whole = [(int(p.getName().split("-")[1]), p.toString()) for p in found if store.exists(spark, f"{p.toString()}/_SUCCESS")]
    return max(whole, default=None)


def write_generation(rows: DataFrame, path: str) -> None:
    """Writes a new generation of a table, in as many files as its bytes ask for, then deletes the ones before the last."""
    spark = rows.sparkSession
    last = _newest(spark, path)
    number = last[0] + 1 if last else 0
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}/generation-{number}")
    fs, folder = store.file_system(spark, path)
    for f in fs.listStatus(folder):
        if int(f.getPath().getName().split("-")[1]) < number - 1:
            fs.delete(f.getPath(), True)


def list_root(spark: SparkSession, root: Root) -> DataFrame:
    """The files of a root that are to be read.

    Of turn logs these are without those of child sessions, whose usage their
    parents count, and of a folder that holds an event table that table alone.
    """
    listing = files.list_tree if root.by_tasks else files.list_files
    if root.provider != "grok" or root.name_filter:
        return listing(spark, root.path, root.name_filter or files.NAME_RULES[root.provider])
    every = listing(spark, root.path, "")
    logs = files.turn_log_files(every)
    folders = files.child_folders(every, logs)
    told = ingest.child_sessions(lines.whole_texts(spark, every.join(folders.where("meta IS NOT NULL").select(F.col("meta").alias("path")), "path", "left_semi")))
    named = told.select("source_path", "session_id")
    children = folders.join(named, F.col("meta") == F.col("source_path"), "left").select(F.coalesce("session_id", "child").alias("session_id")).distinct()
    return logs.withColumn("_session", F.element_at(F.split("path", "/"), -2)).join(children, F.col("_session") == F.col("session_id"), "left_anti").drop("_session")


def ingest_files(spark: SparkSession, provider: str, found: DataFrame, read_at: Column | None = None, scratch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, issues and the paths that gave a line or a document, of files of one provider, each by its family.

    With scratch, a path, rows are written there once they are parsed.
    """
    cut = lambda name: (lambda df: df if scratch is None else _kept(df, f"{scratch}-{name}"))
    documents = found.where(F.col("name").rlike(r"(?i)\.json$"))
    logs = found.where(~F.col("name").rlike(r"(?i)\.json$") & ~files.of_event_table())
    text, tables = lines.scan_lines(spark, logs), None
    if provider == "codex":
        records, issues = ingest.ingest_counter_log(text, provider, read_at, cut("lines"))
    elif provider == "grok":
        records, issues = ingest.ingest_turn_log(text, provider, cut("lines"))
        more_records, more, tables = _event_tables(spark, found, provider)
        records, issues = records.unionByName(more_records), issues.unionByName(more)
    else:
        rows, bad = ingest.parse_rows(text)
        records, more = ingest.ingest_generic(rows, provider, read_at, cut("lines"))
        issues = bad.unionByName(more)
    read = text.select("source_path") if tables is None else text.select("source_path").union(tables)
    if not documents.isEmpty():
        rows, broken = lines.scan_json_docs(spark, documents)
        whole, more = ingest.ingest_generic(ingest.rows_of(rows), provider, read_at, cut("documents"))
        no_json = broken.select("source_path", F.lit("error").alias("severity"), F.lit("malformed_json").alias("code"), F.lit("document is not valid JSON").alias("message"))
        records, issues, read = records.unionByName(whole), quality.all_issues(issues, more, no_json), read.union(rows.select("source_path")).union(broken)
    return records, issues.withColumn("provider", F.coalesce("provider", F.lit(provider))), read.distinct()


def _event_tables(spark: SparkSession, found: DataFrame, provider: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, issues and paths read of event tables, folders of Parquet files named session.db. A database file of that name is not read."""
    parts = found.where(F.col("path").rlike(files.EVENT_PART)).select("path")
    paths = [r.path for r in parts.toLocalIterator()]
    if not paths:
        records, issues = ingest.session_events_to_records(spark.createDataFrame([], "source_path string, " + ", ".join(f"{c} {'bigint' if c.endswith('tokens') else 'string'}" for c in ingest.EVENT_COLUMNS)), provider)
        return records, issues, found.limit(0).select("path")
    table = spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True).parquet(*paths)
    missing = [c for c in ingest.EVENT_COLUMNS if c not in table.columns]
    if missing:
        lacking = parts.select(F.lit("error").alias("severity"), F.lit("unsupported_schema").alias("code"), F.lit(f"missing columns: {', '.join(missing)}").alias("message"), F.col("path").alias("source_path"), F.lit(provider).alias("provider"))
        records, _ = ingest.scan_session_events(table, "", provider)
        return records, quality.all_issues(lacking), parts.select("path")
    records, issues = ingest.session_events_to_records(table.withColumn("source_path", F.col("_metadata.file_path")), provider)
    return records, issues, parts.select("path")


def refresh(spark: SparkSession, roots: Iterable[Root], path: str, span: TimeRange, force: bool = False, settle: tuple[datetime, int] | None = None, version: str = PARSER_VERSION, read_at: Column | None = None) -> Refreshed:
    """Brings the store under path up to date with the roots. With settle (now, seconds), files written to so lately wait.

    A refresh runs the same for a file or a million: lists, the manifest and
    rows are frames, and only the paths to be read come to the driver, as Spark's
    readers want them. Without roots nothing is read and nothing goes.
    """
    roots = list(roots)
    records_path, manifest_path, scratch = f"{path}/records", f"{path}/manifest", f"{path}/scratch-{uuid.uuid4().hex}"
    known = read_manifest(spark, manifest_path)
    manifest = store.manifest_current(known, version)
    # While the mark stands rows may be stored that no entry names: after a refresh that ended early all days are looked through.
    fs, mark = store.file_system(spark, f"{path}/refreshing")
    ended_early = fs.exists(mark)
    fs.create(mark, True).close()
    merged, actions, issues = manifest, [], []
    for root in roots:
        here = f"{scratch}/{len(actions)}"
        listed = _kept(list_root(spark, root), f"{here}-listed")
        waiting = listed if settle is None else quality.settled(listed, *settle)
        mine = manifest.where((F.col("provider") == root.provider) & (F.col("root_id") == store.hashed_id(F.lit(root.provider), F.lit(root.path))))
        todo = _kept(files.files_to_ingest(waiting, mine, span, root.provider, version, force), f"{here}-actions")
        ids = {"provider": F.lit(root.provider), "root_id": store.hashed_id(F.lit(root.provider), F.lit(root.path)), "file_id": store.hashed_id(F.lit(root.provider), F.lit(root.path), F.col("path"))}
        wanted = todo.where("action = 'ingest'").withColumns(ids)
        records, found, read = ingest_files(spark, root.provider, wanted, read_at, f"{here}-parsed")
        records, found, read = (_kept(x, f"{here}-{name}") for name, x in (("records", store.pseudonymise(records, root.path)), ("issues", found), ("read", read)))
        failed = quality.failed_files(wanted, read)
        gone = store.removed_files(mine, listed)
        done = wanted.join(failed.select("path"), "path", "left_anti")
        touched = done.select("file_id").union(gone.select("file_id"))
        store.write_records(records, records_path, touched, None if ended_early else _days_of(known, touched, root.provider))
        new = _kept(store.build_manifest(records, done.select("provider", "root_id", "file_id", "path", "fingerprint"), version), f"{here}-entries")
        merged = store.merge_manifest(merged, new, gone)
        unread = failed.select(F.col("path").alias("source_path"), F.lit("error").alias("severity"), F.lit("file_unreadable").alias("code"), F.lit("file could not be read; its last rows stay").alias("message"), F.lit(root.provider).alias("provider"))
        there = spark.createDataFrame([(store.qualified(spark, root.path), store.exists(spark, root.path))], "root string, exists boolean")
        any_line = lambda df: df.select(F.col("path").alias("source_path"), F.lit("x").alias("value"))
        bare = ingest.source_issues(listed, any_line(listed), any_line(listed), there)
        empty = ingest.source_issues(done, read.withColumn("value", F.lit("x")), _with_records(new), there.where("root IS NULL")).unionByName(bare).withColumn("provider", F.lit(root.provider))
        issues += [found, unread, empty]
        actions.append(todo.withColumns({"provider": F.lit(root.provider), "source_path": F.lit(root.path)}))
    every = reduce(DataFrame.unionByName, actions) if actions else spark.createDataFrame([], ACTIONS_SCHEMA)
    found = quality.all_issues(*issues) if issues else spark.createDataFrame([], ISSUE_SCHEMA)
    write_generation(merged, manifest_path)
    write_generation(every.select(*_columns(ACTIONS_SCHEMA)), f"{path}/actions")
    write_generation(found, f"{path}/issues")
    fs.delete(store.file_system(spark, scratch)[1], True)
    fs.delete(mark, False)
    manifest, every, found = (_read_newest(spark, f"{path}/{name}", schema) for name, schema in (("manifest", store.MANIFEST_SCHEMA), ("actions", ACTIONS_SCHEMA), ("issues", ISSUE_SCHEMA)))
    active = [store.root_id(r.provider, r.path) for r in roots]
    return Refreshed(store.read_range(spark, records_path, span, active), manifest, every, quality.coverage(every, manifest), quality.load_status(every, force), found)


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _days_of(entries: DataFrame, touched: DataFrame, provider: str) -> set[tuple]:
    """The days on which touched files have stored rows, from their entries: no other day has to be looked through."""
    found = entries.join(touched, "file_id", "left_semi").select(F.explode("days").alias("day")).distinct()
    return {(provider, r.day) for r in found.collect()}


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Written and read back, so that files are parsed once and lists stay as they were."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_records(entries: DataFrame) -> DataFrame:
    return entries.where("records > 0").select(F.col("path").alias("source_path"))
