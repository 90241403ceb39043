"""Queries over files, the store, refreshes, coverage and issues, and their SQL."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import resolve_range
from ..operators import filters, ingest, quality, rollup
from ..sources import files, lines, store
from ..sources.shared import opened
from . import demo, usage_queries
from .ingest_queries import _events, _iso, _numbers, _store_path, _text, generic_issues
from .refresh import Refreshed, Root, refresh

YEAR = resolve_range("custom", datetime(2024, 1, 17, tzinfo=timezone.utc), "UTC", "2024-01-01", "2024-12-31")
_NAMES = {"gz": r"(?i)\.jsonl(?:\.gz)?$"}


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Names that follow each other in a batch, and their values, joined."""
    codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
    bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            yield batch.column(0)[a].as_py(), "".join(batch.column(1).slice(a, b - a).to_pylist()).encode()


def write_named(rows: DataFrame, base: str, compression: str | None = None) -> None:
    """Writes rows (file, n, value) as one text file for each name in column file, with folders in it or not, lines in order of n.

    Tasks write the files under their names, since there may be very many; the driver touches none.
    """
    fs, folder = store.file_system(rows.sparkSession, base)
    fs.mkdirs(folder)
    target = fs.makeQualified(folder).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, group in groupby((run for b in batches for run in _runs(b)), key=lambda x: x[0]):
            reached, path = opened(f"{target}/{name}")
            reached.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with reached.open_output_stream(path, compression=compression) as out, io.BufferedWriter(out, 1 << 20) as lines_:
                for _, text in group:
                    lines_.write(text)
        yield from ()

    line = F.concat(F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit("\n"))
    dealt = rows.select("file", "n", line.alias("value")).repartition("file").sortWithinPartitions("file", "n").select("file", "value")
    dealt.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def _plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files of short lines, some blank, some with a carriage return; one has a name that Spark hides, one is no log."""
    i = F.col("event_id")
    u = F.col("user_id") % 10
    name = F.when(u == 3, "__f3.jsonl").when(u == 4, "f4.meta.json").otherwise(_text("f", u, ".jsonl"))
    value = F.concat(F.when(i % 10 == 0, "").otherwise(_text(i, ",", F.col("event_type"))), F.when(i % 7 == 0, "\r").otherwise(""))
    return _events(spark, sf_dir).select(name.alias("file"), i.alias("n"), value.alias("value"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, reads and numbers the lines of log files."""
    base = f"{_store_path(spark)}/logs/2024/01/05"
    write_named(_plain_lines(spark, sf_dir), base)
    fs, empty = store.file_system(spark, f"{base}/empty.jsonl")
    fs.create(empty).close()
    found = files.list_files(spark, base.rsplit("/", 3)[0])
    read = lines.scan_lines(spark, found).groupBy(F.element_at(F.split("source_path", "/"), -1).alias("name")).agg(F.count("*").alias("lines"), F.max("line_no").alias("last_no"), F.count_if(F.col("value") == "").alias("blank"), F.sum(F.length("value")).alias("letters"), F.sum(F.when(F.col("value") != "", F.col("line_no"))).alias("numbers"))
    listed = found.select("name", (F.col("size") > 0).alias("filled"), files.path_date(F.col("path")).cast("string").alias("dated"))
    return listed.join(read, "name", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON documents: arrays, objects that hold rows under one of three names, and single rows."""
    i, (inp, out, _) = F.col("event_id"), _numbers()
    row = _text('{"sessionId":"s', F.col("user_id"), '","tokens":{"input":', inp, ',"output":', out, "}}")
    one = _events(spark, sf_dir).select(F.col("user_id"), i.alias("i"), row.alias("row"))
    whole = one.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]), ",").alias("rows"), F.min_by("row", "i").alias("first"))
    u = F.col("user_id") % 5
    value = F.when(u == 0, _text("[", F.col("rows"), "]")).when(u == 4, F.col("first"))
    for k, name in enumerate(("records", "messages", "entries"), 1):
        value = value.when(u == k, _text(f'{{"{name}":[', F.col("rows"), "]}"))
    base = f"{_store_path(spark)}/docs"
    write_named(whole.select(_text("u", F.col("user_id"), ".json").alias("file"), F.lit(0).alias("n"), value.alias("value")), base)
    rows, _ = lines.scan_json_docs(spark, files.list_tree(spark, base))
    records, _ = ingest.ingest_generic(ingest.rows_of(rows), "claude")
    return records.select(F.element_at(F.split("source_path", "/"), -1).alias("name"), "line_no", "session_id", F.col("tokens.input").alias("input"), F.col("tokens.output").alias("output"))


def _file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with a file for each event: dated paths, sizes and times of change."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    path = F.when(i % 4 == 0, _text("/logs/a/", i, ".jsonl")).otherwise(_text("/logs/", F.when(i % 2 == 0, "a/").otherwise("b/"), F.date_format(ts, "yyyy/MM/dd"), "/", i, ".jsonl"))
    return _events(spark, sf_dir).select(path.alias("path"), _text(i, ".jsonl").alias("name"), i.alias("size"), F.timestamp_millis(F.unix_millis(ts) + (i % 5) * 86_400_000).alias("modified_at"))


def path_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_table(spark, sf_dir).groupBy(files.path_date(F.col("path")).cast("string").alias("dated")).agg(F.count("*").alias("files"))


def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _file_table(spark, sf_dir)
    both = [files.prune_files(found, usage_queries.TWO_DAYS, p).select(F.lit(p).alias("provider"), "size", "skip_reason") for p in ("codex", "claude")]
    return both[0].unionByName(both[1])


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each file, by a manifest that knows two of three, some of them changed since or of an older version."""
    found = _file_table(spark, sf_dir)
    i = F.col("size")
    known = found.where(i % 3 != 0).select(
        F.lit("claude").alias("provider"), "path", F.when(i % 5 == 0, "changed").otherwise(files.fingerprint(found)).alias("fingerprint"), F.when(i % 11 == 0, "0").otherwise("1").alias("parser_version"),
        F.date_sub(F.to_date("modified_at"), 3).cast("timestamp").alias("min_ts"), F.col("modified_at").alias("max_ts"), i.alias("records"),
    )
    return files.files_to_ingest(found, store.manifest_current(known, "1"), usage_queries.TWO_DAYS, "claude", "1")


def file_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("size", "action")


def load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all files, and of those that need no reading."""
    found = _actions(spark, sf_dir)
    parts = {"all": found, "known": found.where("action <> 'ingest'"), "reused": found.where("action = 'reuse' AND skip_reason IS NULL")}
    rows = [quality.load_status(df, force=name == "all").withColumn("part", F.lit(name)) for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _actions(spark, sf_dir).withColumns({"provider": F.lit("claude"), "source_path": F.substring("path", 1, 8)})
    known = _file_table(spark, sf_dir).where("size % 3 <> 0").select("path", F.col("size").alias("records"))
    return quality.coverage(found, known)


def detected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first root that holds files, of each provider."""
    rows = [("claude", "/logs/none", 0, r"\.jsonl$"), ("claude", "/logs/a/", 1, r"\.jsonl$"), ("claude", "/logs", 2, r"\.jsonl$"), ("codex", "/logs/b", 0, r"7\.jsonl$"), ("pi", "/logs/b", 0, r"\.json$"), ("grok", "/logs/b/2024/01", 5, "^1"), ("grok", "/logs/a", 9, "^2")]
    return files.detect_sources(_file_table(spark, sf_dir), spark.createDataFrame(rows, "provider string, root string, priority int, name_filter string"))


def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = datetime(2024, 1, 20, tzinfo=timezone.utc)
    return quality.settled(_file_table(spark, sf_dir), now, 3600).select("size")


def source_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a line, without a record, and roots that are empty or gone."""
    found = _file_table(spark, sf_dir)
    i = F.col("size")
    read = found.where(i % 10 != 0).select(F.col("path").alias("source_path"), F.when(i % 10 == 1, " ").otherwise("x").alias("value"))
    records = found.where(i % 10 > 2).select(F.col("path").alias("source_path"))
    roots = spark.createDataFrame([("/logs/a", True), ("/logs/b", True), ("/logs/c", True), ("/gone", False)], "root string, exists boolean")
    return ingest.source_issues(found, read, records, roots).select("severity", "code", "source_path")


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _file_table(spark, sf_dir)
    read = found.where("size % 10 NOT IN (0, 7)").select(F.col("path").alias("source_path"))
    return quality.failed_files(found, read).select("path")


def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without records, a provider for each supplier; some were not read whole or not without fault, and some have another root."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    provider = _text("p", F.col("k"))
    cover = s.select(provider.alias("provider"), F.lit("/configured").alias("source_path"), (F.col("k") % 2).alias("records"), (F.col("k") % 5 != 0).alias("complete"))
    code = F.when(F.col("k") % 7 == 0, "file_transient").otherwise("no_records")
    issues = s.where("k % 3 = 0").select(F.lit("warning").alias("severity"), code.alias("code"), provider.alias("provider"))
    seen = s.where("k % 11 <> 0").select(provider.alias("provider"), F.when(F.col("k") % 13 == 0, "/configured").otherwise("/other").alias("source_path"))
    return quality.stale_sources(cover, issues, seen).select("code", "message", "source_path", "provider")


def checked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    u = F.col("k") % 4
    path = F.when(u == 0, _text("/home/u", F.col("k"))).when(u == 1, _text("D:\\u", F.col("k"))).when(u == 2, _text("\\\\host\\", F.col("k"))).otherwise("  ")
    sources = s.select(_text("p", F.col("k")).alias("provider"), path.alias("path"))
    both = [quality.check_paths(sources, p).withColumn("platform", F.lit(p)) for p in ("linux", "win32")]
    return both[0].unionByName(both[1]).select("platform", "code", "source_path", "provider")


def append_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the rows of files up to an ordinal, then adds later ones, some of them stored already, twice."""
    path = _store_path(spark)
    records = store.pseudonymise(demo.usage_from_events(spark, sf_dir), "root")
    head = records.where("seq < 700")
    store.write_records(head, path, head.select("file_id"))
    before = records.groupBy("file_id").agg(F.lit(600).cast("bigint").alias("records"))
    for _ in range(2):
        store.append_records(records.where("seq >= 300"), path, before)
    return store.read_records(spark, path).groupBy("file_id").agg(F.count("*").alias("records"), F.countDistinct("seq").alias("ordinals"), F.sum("tokens.input").alias("input"))


def _flat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, (inp, out, _) = F.col("event_id"), _numbers()
    value = _text('{"model":"m', F.col("user_id") % 3, '","sessionId":"s', F.col("user_id"), '","startedAt":"', _iso(F.col("ts")), '","tokens":{"input":', inp, ',"output":', out, "}}")
    return _events(spark, sf_dir).select(_text("f", F.col("user_id") % 6, ".jsonl").alias("file"), i.alias("n"), value.alias("value"))


def _refreshed_twice(spark: SparkSession, sf_dir: str) -> tuple[Refreshed, str]:
    """Six files, of which one changes, one goes and one breaks between two refreshes; a third changes nothing."""
    path = _store_path(spark)
    base = f"{path}/logs"
    logs = _flat_logs(spark, sf_dir)
    write_named(logs.where("file <> 'f3.jsonl'"), base)
    write_named(logs.where("file = 'f3.jsonl'").withColumn("file", F.lit("f3.jsonl.gz")), base, "gzip")
    roots = [Root("claude", base, _NAMES["gz"])]
    refresh(spark, roots, path, YEAR)
    write_named(logs.where("file = 'f1.jsonl' AND n % 2 = 0"), base)
    fs, gone = store.file_system(spark, f"{base}/f2.jsonl")
    fs.delete(gone, False)
    broken = fs.create(store.file_system(spark, f"{base}/f3.jsonl.gz")[1], True)
    broken.write(bytearray(b"no archive"))
    broken.close()
    return refresh(spark, roots, path, YEAR), path


def refreshed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _refreshed_twice(spark, sf_dir)
    return done.records.groupBy(F.col("utc_date").cast("string").alias("utc_date"), "model").agg(F.count("*").alias("records"), F.countDistinct("session_id").alias("sessions"), F.sum("tokens.input").alias("input"))


def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions, coverage, status, issues and manifest of the second refresh, as kind, name and number."""
    done, _ = _refreshed_twice(spark, sf_dir)

    def of(kind: str, df: DataFrame, name: str, n: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.expr(name).alias("name"), F.expr(n).cast("bigint").alias("n"))

    parts = [
        of("action", done.actions.groupBy("action").agg(F.count("*").alias("n")), "action", "n"),
        of("coverage", done.coverage, "concat(provider, if(complete, ' complete', ' partial'))", "records"),
        of("files", done.coverage, "provider", "files"),
        of("status", done.status, "status", "if(history_complete, 1, 0)"),
        of("issue", done.issues.groupBy("severity", "code").agg(F.count("*").alias("n")), "concat(severity, ' ', code)", "n"),
        of("manifest", done.manifest.groupBy("provider").agg(F.sum("records").alias("n")), "provider", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of log lines, files and paths in one table, by provider and without one, errors first."""
    lint = source_issues(spark, sf_dir)
    every = quality.all_issues(generic_issues(spark, sf_dir), lint, checked_paths(spark, sf_dir))
    kept = filters.issues_for_provider(every, "claude")
    return kept.groupBy("severity", "code", "provider").agg(F.count("*").alias("issues"))


def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.issues_for_provider(generic_issues(spark, sf_dir), "codex")
    return rollup.top_issues(found, 20).select("severity", "code", "source_path", "line_no")


def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose span meets a range."""
    from ..functions.timez import literal

    span = usage_queries.TWO_DAYS
    found = demo.usage_from_events(spark, sf_dir).groupBy("provider", "session_id").agg(F.min("started_at").alias("a"), F.max("started_at").alias("b"), F.count("*").alias("records"))
    return found.where(filters.spans_overlap(F.col("a"), F.col("b"), literal(span.start), literal(span.end))).select("provider", "session_id", "records")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        log_files, json_documents, path_dates, pruned_files, file_actions, load_status, source_coverage, detected_sources, settled_files, source_issues, failed_files, stale_sources, checked_paths,
        append_tail, refreshed_records, refresh_report, all_issues, first_issues, overlapping_sessions,
    )
    return {f.__name__: f for f in found}


# SQL -----------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    from .ingest_queries import oracle_sql as ingest_sql

    span = usage_queries.TWO_DAYS
    stamp = lambda t: f"TIMESTAMP '{t.strftime('%Y-%m-%d %H:%M:%S.%f')}'"
    listing = """f AS (
        SELECT event_id AS size, event_id || '.jsonl' AS name, date_trunc('millisecond', ts) + INTERVAL (event_id % 5) DAY AS modified_at,
          CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS dated,
          CASE WHEN event_id % 4 = 0 THEN '/logs/a/' || event_id || '.jsonl' ELSE '/logs/' || CASE WHEN event_id % 2 = 0 THEN 'a/' ELSE 'b/' END || strftime(ts, '%Y/%m/%d') || '/' || event_id || '.jsonl' END AS path
        FROM events)"""
    start, end = span.start, span.end
    after, unmodified = f"dated > CAST({stamp(end)} + INTERVAL 1 DAY AS DATE)", f"modified_at < {stamp(start)} - INTERVAL 1 DAY"
    before = f"dated < CAST({stamp(start)} - INTERVAL 1 DAY AS DATE)"
    reason = f"CASE WHEN {after} THEN 'after_range' WHEN {unmodified} THEN 'not_modified_since'"
    actions = f"""{listing}, a AS (
        SELECT *, {reason} WHEN {before} THEN 'before_range' END AS skip_reason, size % 3 <> 0 AND size % 11 <> 0 AS known, size % 5 <> 0 AS same,
          CAST(CAST(modified_at AS DATE) - 3 AS TIMESTAMP) <= {stamp(end)} AND {stamp(start)} <= modified_at AS inside
        FROM f), d AS (
        SELECT *, CASE WHEN known AND same AND inside THEN 'reuse' WHEN known AND same THEN 'skip' WHEN NOT known AND skip_reason IS NOT NULL THEN 'skip' ELSE 'ingest' END AS action FROM a)"""
    flat = "SELECT *, CAST(floor(value * 1000) AS BIGINT) AS inp, CAST(floor(value * 100) AS BIGINT) AS out_ FROM events"
    left = f"SELECT * FROM ({flat}) WHERE (user_id % 6 IN (0, 3, 4, 5) OR (user_id % 6 = 1 AND event_id % 2 = 0)) AND (inp > 0 OR out_ > 0)"
    issues = f"""source AS (
          SELECT 'warning' AS severity, 'empty_file' AS code, path AS source_path FROM f WHERE size % 10 IN (0, 1) UNION ALL
          SELECT 'warning', 'no_records', path FROM f WHERE size % 10 = 2 UNION ALL
          SELECT 'warning', 'missing_path', '/gone' UNION ALL SELECT 'warning', 'empty_directory', '/logs/c')"""
    checked = """paths AS (
          SELECT s_suppkey AS k, 'p' || s_suppkey AS provider, CASE s_suppkey % 4 WHEN 0 THEN '/home/u' || s_suppkey WHEN 1 THEN 'D:\\u' || s_suppkey WHEN 2 THEN '\\\\host\\' || s_suppkey ELSE '' END AS source_path FROM supplier)"""
    generic = ingest_sql()["generic_issues"]
    return {
        "log_files": """WITH e AS (
              SELECT *, user_id % 10 AS u, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS no, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_id || ',' || event_type END AS v FROM events WHERE user_id % 10 <> 4
            ) SELECT CASE WHEN u = 3 THEN '__f3.jsonl' ELSE 'f' || u || '.jsonl' END AS name, TRUE AS filled, '2024-01-05' AS dated, count(*) AS lines, max(no) AS last_no, count(*) FILTER (v = '') AS blank,
              CAST(sum(length(v)) AS BIGINT) AS letters, CAST(sum(no) FILTER (v <> '') AS BIGINT) AS numbers FROM e GROUP BY u
            UNION ALL SELECT 'empty.jsonl', FALSE, '2024-01-05', 0, NULL, NULL, NULL, NULL""",
        "json_documents": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM ({flat}))
            SELECT 'u' || user_id || '.json' AS name, no AS line_no, 's' || user_id AS session_id, inp AS input, out_ AS output FROM e WHERE (user_id % 5 <> 4 OR no = 1) AND (inp > 0 OR out_ > 0)""",
        "path_dates": f"WITH {listing} SELECT CAST(dated AS VARCHAR) AS dated, count(*) AS files FROM f GROUP BY 1",
        "pruned_files": f"WITH {listing} SELECT 'codex' AS provider, size, {reason} END AS skip_reason FROM f UNION ALL SELECT 'claude', size, {reason} WHEN {before} THEN 'before_range' END FROM f",
        "file_actions": f"WITH {actions} SELECT size, action FROM d",
        "load_status": f"""WITH {actions}, p AS (SELECT 'all' AS part, * FROM d UNION ALL SELECT 'known', * FROM d WHERE action <> 'ingest' UNION ALL SELECT 'reused', * FROM d WHERE action = 'reuse' AND skip_reason IS NULL)
            SELECT part, CASE WHEN count(*) FILTER (action = 'ingest') > 0 THEN 'rebuilding' WHEN count(*) FILTER (action = 'skip' AND skip_reason IS NOT NULL) = 0 THEN 'warm' ELSE 'partial' END AS status,
              count(*) FILTER (action = 'skip' AND skip_reason IS NOT NULL) = 0 AS history_complete FROM p GROUP BY part""",
        "source_coverage": f"""WITH {actions} SELECT 'claude' AS provider, path[1:8] AS source_path, count(*) AS files, CAST(sum(CASE WHEN size % 3 <> 0 THEN size ELSE 0 END) AS BIGINT) AS records,
              count(*) FILTER (action = 'skip' AND size % 3 = 0) = 0 AS complete FROM d GROUP BY 2""",
        "detected_sources": f"""WITH {listing} SELECT 'claude' AS provider, '/logs/a/' AS source_path, count(*) AS files FROM f WHERE path LIKE '/logs/a/%'
            UNION ALL SELECT 'codex', '/logs/b', count(*) FROM f WHERE path LIKE '/logs/b/%' AND name LIKE '%7.jsonl' UNION ALL SELECT 'grok', '/logs/b/2024/01', count(*) FROM f WHERE path LIKE '/logs/b/2024/01/%' AND name LIKE '1%'""",
        "settled_files": f"WITH {listing} SELECT size FROM f WHERE modified_at <= TIMESTAMP '2024-01-19 23:00:00'",
        "source_issues": f"WITH {listing}, {issues} SELECT * FROM source",
        "failed_files": f"WITH {listing} SELECT path FROM f WHERE size > 0 AND size % 10 IN (0, 7)",
        "stale_sources": """SELECT 'source_alternative_detected' AS code, 'files were found in /other' AS message, '/configured' AS source_path, 'p' || s_suppkey AS provider FROM supplier
            WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AND NOT (s_suppkey % 3 = 0 AND s_suppkey % 7 = 0) AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0""",
        "checked_paths": f"""WITH {checked} SELECT 'linux' AS platform, 'non_native_path' AS code, source_path, provider FROM paths WHERE k % 4 IN (1, 2)
            UNION ALL SELECT 'win32', 'non_native_path', source_path, provider FROM paths WHERE k % 4 = 0""",
        "append_tail": usage_queries.with_usage("SELECT substr(sha256(provider || chr(0) || 'root' || chr(0) || source_path), 1, 24) AS file_id, count(*) AS records, count(*) AS ordinals, CAST(sum(input) AS BIGINT) AS input FROM usage GROUP BY 1"),
        "refreshed_records": f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_date, 'm' || (user_id % 3) AS model, count(*) AS records, count(DISTINCT user_id) AS sessions, CAST(sum(inp) AS BIGINT) AS input FROM ({left}) GROUP BY 1, 2""",
        "refresh_report": f"""SELECT 'action' AS kind, 'ingest' AS name, 2 AS n UNION ALL SELECT 'action', 'reuse', 3 UNION ALL SELECT 'files', 'claude', 5 UNION ALL SELECT 'status', 'cold', 1 UNION ALL SELECT 'issue', 'error file_unreadable', 1
            UNION ALL SELECT 'coverage', 'claude complete', count(*) FROM ({left}) UNION ALL SELECT 'manifest', 'claude', count(*) FROM ({left})""",
        "all_issues": f"""WITH {listing}, {issues}, {checked}, g AS ({generic})
            SELECT severity, code, provider, count(*) AS issues FROM (SELECT severity, code, provider FROM g WHERE provider = 'claude' OR provider IS NULL UNION ALL SELECT severity, code, NULL FROM source) GROUP BY 1, 2, 3""",
        "first_issues": f"""SELECT severity, code, source_path, line_no FROM ({generic}) WHERE provider IS NULL ORDER BY CASE WHEN severity = 'error' THEN 0 ELSE 1 END, code, source_path, line_no LIMIT 20""",
        "overlapping_sessions": usage_queries.with_usage(f"SELECT provider, session_id, count(*) AS records FROM usage GROUP BY 1, 2 HAVING min(ts) <= {stamp(end)} AND {stamp(start)} <= max(ts)"),
    }
