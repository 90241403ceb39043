"""Queries that turn the test tables into log lines and read these, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, quality
from ..schema import TOKENS
from ..sources import store
from ..sources.shared import new_path, small_methods, written
from ..streaming import deltas
from . import demo, usage_queries

_DELTA_COLUMNS = ["input", "cached_input", "output"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _model() -> Column:
    i = F.col("event_id")
    return F.when(i % 7 != 0, F.get(F.array(*map(F.lit, demo.MODELS)), (F.col("user_id") % 6).cast("int")))


def _numbers() -> tuple[Column, Column, Column]:
    return F.floor(F.col("value") * 1000), F.floor(F.col("value") * 100), F.get_json_object("props", "$.k").cast("bigint")


def generic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in five shapes: flat, transcript, billed, header without usage, and ones with wrong types or broken text."""
    i, (inp, out, k) = F.col("event_id"), _numbers()
    model = F.coalesce(_text('"model":"', _model(), '",'), F.lit(""))
    at = _iso(F.col("ts"))
    flat = _text('{"provider":"', F.when(i % 3 == 0, "codex").otherwise("claude"), '",', model, '"sessionId":"s', F.col("user_id"), '","startedAt":"', at, '","tokens":{"input":', inp, ',"output":', out, "}}")
    transcript = _text('{"type":"assistant","timestamp":"', at, '","message":{', model, '"usage":{"input_tokens":', inp, ',"output_tokens":', out, ',"cache_creation_input_tokens":', k, ',"cache_read_input_tokens":', k * 2, "}}}")
    billed = _text('{"timestamp":"', at, '","message":{"usage":{"input":', inp, ',"cost":{"total":', k, '.25,"currency":"eur"}}}}')
    header = _text('{"type":"session","id":"h', F.col("user_id"), '",', model, '"timestamp":"', at, '"}')
    typed = _text("{", model, '"timestamp":"', at, '","usage":{"input":"12","inputTokens":5,"output_tokens":', out, "}}")
    odd = F.when(i % 25 == 4, F.lit("{bad")).when(i % 25 == 9, F.lit("[1,2]")).when(i % 25 == 14, F.lit("  ")).otherwise(typed)
    value = F.when(i % 5 == 0, flat).when(i % 5 == 1, transcript).when(i % 5 == 2, billed).when(i % 5 == 3, header).otherwise(odd)
    return _events(spark, sf_dir).select(_text("logs/f", F.col("user_id") % 10, ".jsonl").alias("source_path"), i.alias("line_no"), value.alias("value"))


def _generic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, issues = ingest.parse_rows(generic_lines(spark, sf_dir))
    records, more = ingest.ingest_generic(rows, "claude")
    return records, issues.unionByName(more)


def ingest_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = _generic(spark, sf_dir)
    return records.select("line_no", "seq", "model", "session_id", F.unix_millis("started_at").alias("started_ms"), *[F.col(f"tokens.{t}").alias(t) for t in TOKENS], F.col("imported_cost.amount").cast("double").alias("cost"), F.col("imported_cost.currency").alias("currency"))


def ingest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, issues = _generic(spark, sf_dir)
    return issues.select("severity", "code", "source_path", "line_no")


def generic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of the generic lines, with the provider that those of records carry."""
    _, issues = _generic(spark, sf_dir)
    return issues.select("severity", "code", "source_path", "line_no", "provider")


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter log for each order: running totals with a reset, a context row, bulk lines, null heartbeats, and lines that begin with a stray backslash."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    totals = _counters(li)
    no = F.col("line") * 4
    event = _text('{"timestamp":"2024-01-01T00:00:00Z","type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":', F.col("input"), ',"cached_input_tokens":', F.col("cached_input"), ',"output_tokens":', F.col("output"), "}}}}")
    context = _text('{"type":"turn_context","payload":{"model":"', F.get(F.array(*map(F.lit, demo.MODELS)), (F.col("l_orderkey") % 6).cast("int")), '"}}')
    bulk = F.lit('{"type":"response_item","payload":{"text":"long"}}')
    beat = F.lit('{"type":"event_msg","payload":{"type":"token_count","info":null}}')
    lines = F.array(F.struct((no - 3).alias("line_no"), F.when((F.col("line") == 2) & (F.col("l_orderkey") % 2 == 0), context).otherwise(bulk).alias("value")), F.struct((no - 1).alias("line_no"), beat.alias("value")), F.struct(no.alias("line_no"), F.when(F.col("line") % 3 == 1, _text("\\", event)).otherwise(event).alias("value")))
    return totals.select(_text("2024/01/01/o", F.col("l_orderkey"), ".jsonl").alias("source_path"), F.explode(lines).alias("l")).select("source_path", F.col("l.line_no").cast("bigint").alias("line_no"), F.col("l.value").alias("value"))


#: Lines that one task sorts, about.
TASK_LINES = 500_000


def _counters(li: DataFrame) -> DataFrame:
    """Running sums over each order's lines; every fifth line starts over.

    Orders are dealt to tasks by the number of lines, which the files' footers tell, so that a task's memory doesn't grow with the table.
    """
    from pyspark.sql import Window

    li = li.repartition(max(li.sparkSession.sparkContext.defaultParallelism, li.count() // TASK_LINES + 1), "l_orderkey")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = li.withColumn("line", F.row_number().over(by)).withColumn("part", F.floor((F.col("line") - 1) / 5))
    run = Window.partitionBy("l_orderkey", "part").orderBy("line")
    q = F.col("l_quantity").cast("bigint")
    return rows.select("l_orderkey", F.col("line").cast("bigint").alias("line"), F.sum(q * 10).over(run).alias("input"), F.sum(q * 3).over(run).alias("cached_input"), F.sum(q).over(run).alias("output"))


def cumulative_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counters(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return ingest.cumulative_to_delta(rows, ["l_orderkey"], ["line"], _DELTA_COLUMNS)


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_methods(spark)
    cut = lambda rows: written(rows, "counter-rows")
    records, _ = ingest.ingest_counter_log(counter_lines(spark, sf_dir), cut=cut, cut_used=cut)
    return records.select("source_path", "line_no", "seq", "model", "own_model", "session_id", *[F.col(f"tokens.{t}").alias(t) for t in _DELTA_COLUMNS])


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with value, a finished turn of one or two models each."""
    i, (inp, out, k) = F.col("event_id"), _numbers()
    usage = lambda a, b, c: _text('{"inputTokens":', a, ',"outputTokens":', b, ',"totalTokens":', F.when(i % 4 == 0, a + b + 1).otherwise(a + b), ',"cachedReadTokens":', c, ',"costUsdTicks":', a * 1000, "}")
    second = F.when(i % 2 == 0, _text(',"grok-mini":', usage(out, k, F.lit(0)))).otherwise(F.lit(""))
    turn = _text('{"timestamp":', F.unix_seconds(F.col("ts").cast("timestamp")), ',"params":{"update":{"sessionUpdate":"', F.when(i % 9 == 0, "other").otherwise("turn_completed"), '","usage":{"modelUsage":{"grok-core":', usage(inp, out, k), second, "}}}}}")
    return _events(spark, sf_dir).withColumn("value", turn)


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished turn for each event, with one or two models."""
    lines = turn_lines(spark, sf_dir).select(_text("root/cwd/s", F.col("user_id"), "/updates.jsonl").alias("source_path"), F.col("event_id").alias("line_no"), "value")
    records, _ = ingest.ingest_turn_log(lines)
    return records.select("line_no", "model", "session_id", F.unix_seconds("started_at").alias("started_s"), F.col("tokens.input").alias("input"), F.col("tokens.output").alias("output"), F.col("tokens.cache_read").alias("cache_read"), F.col("imported_cost.amount").cast("double").alias("cost"))


def _event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, (inp, out, k) = F.col("event_id"), _numbers()
    start = F.when(i % 13 == 0, F.lit("soon")).otherwise(_iso(F.col("ts")))
    return _events(spark, sf_dir).select(
        i.cast("string").alias("event_id"), _text("s", F.col("user_id")).alias("session_id"), F.when(i % 5 != 0, F.lit("grok-core")).alias("model"), start.alias("started_at"), F.lit(None).cast("string").alias("completed_at"),
        F.when(i % 11 == 0, 0).otherwise(inp).alias("input_tokens"), F.when(i % 11 == 0, 0).otherwise(out).alias("output_tokens"), F.when(i % 3 == 0, k).otherwise(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = ingest.scan_session_events(_event_table(spark, sf_dir), "session.db")
    return records.select("seq", "model", "session_id", F.unix_millis("started_at").alias("started_ms"), F.col("tokens.input").alias("input"), F.col("tokens.output").alias("output"), F.col("tokens.cache_read").alias("cache_read"), "pricing_unavailable")


def session_event_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, issues = ingest.scan_session_events(_event_table(spark, sf_dir), "session.db")
    return issues.select("code", "n", "source_path")


def child_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that no other conversation has started."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    meta = turns.where("turn = 0 AND conv_id % 7 = 3").select(_text("root/subagents/", F.col("conv_id"), "/meta.json").alias("source_path"), F.when(F.col("conv_id") % 2 == 0, _text('{"child_session_id":"', F.col("conv_id"), '"}')).otherwise(F.lit("{}")).alias("value"))
    records = turns.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role")
    return ingest.drop_child_sessions(records, ingest.child_sessions(meta))


#: What the scan of the test tables looks for.
_SCAN = (*quality.DENY_PATTERNS, (r"\b[0-9]{13,16}\b", "card-like number"), (r"(?i)\btoken\s*=\s*\"[0-9a-f]{16,}", "assigned token"), (r"https?://[a-z]+\.example\.com/", "example link"))


def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("table_name"), F.col("page_id").alias("id"), F.concat_ws("\n", "url", "html").alias("text"))
    return quality.scan_patterns(docs.unionByName(pages), "text", ["table_name", "id"], _SCAN)


def _store_path(spark: SparkSession) -> str:
    return new_path(spark, "store")


def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all records, stores the files of one provider anew, and reads a range back."""
    path = _store_path(spark)
    records = store.pseudonymise(demo.usage_from_events(spark, sf_dir), "root")
    store.write_records(records, path, records.select("file_id"))
    again = records.where("provider = 'codex'")
    store.write_records(again, path, again.select("file_id"))
    found = store.read_range(spark, path, usage_queries.TWO_DAYS)
    return found.groupBy("provider", F.col("file_id")).agg(F.count("*").alias("records"), F.sum("tokens.input").alias("input"), F.min("seq").alias("first_seq"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = store.pseudonymise(demo.usage_from_events(spark, sf_dir), "root")
    files = records.select("provider", "root_id", "file_id").distinct().withColumns({"path": F.col("file_id"), "fingerprint": F.lit("1:1")})
    found = store.build_manifest(records, files, "v1")
    return found.select("provider", "file_id", "records", F.size("days").alias("days"), F.unix_millis("min_ts").alias("min_ms"), F.unix_millis("max_ts").alias("max_ms"), F.array_join("models", ",").alias("models"))


def streamed_deltas(spark: SparkSession, sf_dir: str, base: str, after: Callable[[set], None] | None = None) -> None:
    """The counter log as a stream of line segments, stored under base batch by batch."""
    small_methods(spark)
    lines = counter_lines(spark, sf_dir).where(F.col("source_path").isNotNull())
    # Two segments of each file, in one pass.
    lines.withColumn("segment", (F.col("line_no") > 8).cast("int")).write.partitionBy("segment").parquet(f"{base}/lines")
    source = spark.readStream.schema("source_path string, line_no bigint, value string").parquet(f"{base}/lines")
    query = source.writeStream.foreachBatch(deltas.upsert(base, "codex", "root", after)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter log as a stream, read back from where it was stored."""
    base = _store_path(spark)
    streamed_deltas(spark, sf_dir, base)
    return store.read_records(spark, f"{base}/records").select("file_id", "line_no", "model", *[F.col(f"tokens.{t}").alias(t) for t in _DELTA_COLUMNS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (ingest_generic, ingest_issues, generic_issues, cumulative_delta, counter_log, turn_log, session_events, session_event_issues, child_sessions, pattern_scan, store_range, manifest, stream_deltas)}


# SQL -----------------------------------------------------------------------

_MODELS = "[" + ", ".join(f"'{m}'" for m in demo.MODELS) + "]"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_ROWS = f"""
rows AS (
  SELECT event_id AS i, event_id % 5 AS kind, user_id, 'logs/f' || (user_id % 10) || '.jsonl' AS source_path,
    CASE WHEN event_id % 5 = 4 AND event_id % 25 IN (4, 9, 14) THEN event_id % 25 END AS odd,
    CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 2 THEN ({_MODELS})[user_id % 6 + 1] END AS model_said,
    CAST(floor(value * 1000) AS BIGINT) AS inp, CAST(floor(value * 100) AS BIGINT) AS out_, {_K} AS k, epoch_ms(date_trunc('millisecond', ts)) AS ms
  FROM events
), good AS (
  SELECT *, CASE WHEN kind = 0 THEN 's' || user_id END AS session_said, CASE WHEN kind = 0 THEN 's' || user_id WHEN kind = 3 THEN 'h' || user_id END AS context_said
  FROM rows WHERE odd IS NULL
), filled AS (
  SELECT *, last_value(model_said IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY i) AS model_before,
    CASE WHEN min(model_said) OVER (PARTITION BY source_path) = max(model_said) OVER (PARTITION BY source_path) THEN min(model_said) OVER (PARTITION BY source_path) END AS only_model,
    last_value(context_said IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY i) AS context_before
  FROM good
), used AS (
  SELECT i AS line_no, coalesce(model_before, only_model) AS model, coalesce(session_said, context_before, regexp_extract(source_path, '([^/]+)\\.jsonl', 1)) AS session_id, ms AS started_ms, source_path, kind,
    CASE WHEN kind IN (0, 1, 2) THEN inp END AS input, CASE WHEN kind IN (0, 1, 4) THEN out_ END AS output, CAST(NULL AS BIGINT) AS cached_input,
    CASE WHEN kind = 1 THEN 2 * k END AS cache_read, CASE WHEN kind = 1 THEN k END AS cache_write_5m, CAST(NULL AS BIGINT) AS cache_write_1h,
    CASE WHEN kind = 2 THEN k + 0.25 END AS cost, CASE WHEN kind = 2 THEN 'EUR' END AS currency
  FROM filled WHERE kind <> 3
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY line_no) - 1 AS seq FROM used
  WHERE greatest(coalesce(input, 0), coalesce(output, 0), coalesce(cache_read, 0), coalesce(cache_write_5m, 0)) > 0 OR cost IS NOT NULL
)"""
_COUNTERS = """
numbered AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, CAST(l_quantity AS BIGINT) AS q FROM lineitem
), totals AS (
  SELECT l_orderkey, line, CAST(sum(q * 10) OVER w AS BIGINT) AS input, CAST(sum(q * 3) OVER w AS BIGINT) AS cached_input, CAST(sum(q) OVER w AS BIGINT) AS output
  FROM numbered WINDOW w AS (PARTITION BY l_orderkey, (line - 1) // 5 ORDER BY line)
), deltas AS (
  SELECT l_orderkey, line, greatest(0, input - coalesce(lag(input) OVER w, 0)) AS input, greatest(0, cached_input - coalesce(lag(cached_input) OVER w, 0)) AS cached_input, greatest(0, output - coalesce(lag(output) OVER w, 0)) AS output
  FROM totals WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)
), counted AS (
  SELECT '2024/01/01/o' || l_orderkey || '.jsonl' AS source_path, line * 4 AS line_no, line, l_orderkey, greatest(0, input - cached_input) AS input, cached_input, output,
    CASE WHEN l_orderkey % 2 = 0 AND max(line) OVER (PARTITION BY l_orderkey) >= 2 THEN ({models})[l_orderkey % 6 + 1] END AS model
  FROM deltas WHERE greatest(input, cached_input, output) > 0
)""".replace("{models}", _MODELS)


def oracle_sql() -> dict[str, str]:
    has_context = "l_orderkey IN (SELECT l_orderkey FROM numbered WHERE line = 2) AND l_orderkey % 2 = 0"
    scan = reduce(lambda a, b: f"{a} UNION ALL {b}", [f"SELECT table_name, id, '{reason}' AS reason FROM texts WHERE regexp_matches(text, '{_re2(p)}')" for p, reason in _SCAN if "(?!" not in p])
    file_id = lambda path: f"substr(sha256(provider || chr(0) || 'root' || chr(0) || {path}), 1, 24)"
    usage = usage_queries.with_usage
    inside = usage_queries._inside(usage_queries.TWO_DAYS)
    turns = f"""WITH e AS (
        SELECT event_id AS i, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS started_s, CAST(floor(value * 1000) AS BIGINT) AS inp, CAST(floor(value * 100) AS BIGINT) AS out_, {_K} AS k FROM events WHERE event_id % 9 <> 0
      ), m AS (
        SELECT i, user_id, started_s, 'grok-core' AS model, inp AS a, out_ AS b, k AS c FROM e UNION ALL SELECT i, user_id, started_s, 'grok-mini', out_, k, 0 FROM e WHERE i % 2 = 0
      ), t AS (
        SELECT *, CASE WHEN i % 4 = 0 THEN a ELSE greatest(0, a - c) END AS split FROM m
      )
      SELECT i AS line_no, model, 's' || user_id AS session_id, started_s, nullif(split, 0) AS input, nullif(b, 0) AS output, nullif(c, 0) AS cache_read, CAST(a * 1000 AS DOUBLE) / 1e10 AS cost FROM t WHERE split > 0 OR b > 0 OR c > 0"""
    table = f"""e AS (
        SELECT event_id AS i, 's' || user_id AS session_id, CASE WHEN event_id % 5 <> 0 THEN 'grok-core' END AS model, CASE WHEN event_id % 13 <> 0 THEN epoch_ms(date_trunc('millisecond', ts)) END AS started_ms,
          CASE WHEN event_id % 11 <> 0 THEN nullif(CAST(floor(value * 1000) AS BIGINT), 0) END AS input, CASE WHEN event_id % 11 <> 0 THEN nullif(CAST(floor(value * 100) AS BIGINT), 0) END AS output,
          CASE WHEN event_id % 3 = 0 THEN nullif({_K}, 0) END AS cache_read FROM events
      ), s AS (SELECT *, coalesce(input, output, cache_read) IS NOT NULL AS has_any FROM e)"""
    return {
        "ingest_generic": f"WITH {_ROWS} SELECT line_no, seq, model, session_id, started_ms, input, output, cached_input, cache_read, cache_write_5m, cache_write_1h, CAST(cost AS DOUBLE) AS cost, currency FROM kept",
        "ingest_issues": f"""WITH {_ROWS} SELECT 'error' AS severity, 'malformed_jsonl' AS code, source_path, i AS line_no FROM rows WHERE odd = 4
            UNION ALL SELECT 'warning', 'record_not_object', source_path, i FROM rows WHERE odd = 9
            UNION ALL SELECT 'warning', 'provider_mismatch', source_path, line_no FROM kept WHERE kind = 0 AND line_no % 3 = 0
            UNION ALL SELECT 'warning', 'missing_tokens', source_path, line_no FROM kept WHERE coalesce(input, output, cache_read, cache_write_5m) IS NULL""",
        "generic_issues": f"""WITH {_ROWS} SELECT 'error' AS severity, 'malformed_jsonl' AS code, source_path, i AS line_no, CAST(NULL AS VARCHAR) AS provider FROM rows WHERE odd = 4
            UNION ALL SELECT 'warning', 'record_not_object', source_path, i, NULL FROM rows WHERE odd = 9
            UNION ALL SELECT 'warning', 'provider_mismatch', source_path, line_no, 'claude' FROM kept WHERE kind = 0 AND line_no % 3 = 0
            UNION ALL SELECT 'warning', 'missing_tokens', source_path, line_no, 'claude' FROM kept WHERE coalesce(input, output, cache_read, cache_write_5m) IS NULL""",
        "cumulative_delta": f"WITH {_COUNTERS} SELECT * FROM deltas",
        "counter_log": f"""WITH {_COUNTERS} SELECT source_path, line_no, row_number() OVER (PARTITION BY source_path ORDER BY line_no) - 1 AS seq, model,
            CASE WHEN {has_context} AND line >= 2 THEN model END AS own_model, 'o' || l_orderkey AS session_id, input, cached_input, output
            FROM (SELECT * REPLACE (CASE WHEN {has_context} THEN ({_MODELS})[l_orderkey % 6 + 1] END AS model) FROM counted)""",
        "turn_log": turns,
        "session_events": f"""WITH {table} SELECT row_number() OVER (ORDER BY started_ms, CAST(i AS VARCHAR)) - 1 AS seq, model, session_id, started_ms, input, output, cache_read, cache_read IS NOT NULL AS pricing_unavailable
            FROM s WHERE has_any AND started_ms IS NOT NULL""",
        "session_event_issues": f"""WITH {table} SELECT code, n, 'session.db' AS source_path FROM (
            SELECT 'no_token_usage' AS code, count(*) FILTER (NOT has_any) AS n FROM s UNION ALL SELECT 'invalid_timestamp', count(*) FILTER (has_any AND started_ms IS NULL) FROM s
            UNION ALL SELECT 'ambiguous_cache_tokens', count(*) FILTER (has_any AND started_ms IS NOT NULL AND cache_read IS NOT NULL) FROM s) WHERE n > 0""",
        "child_sessions": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role FROM conversations WHERE conv_id % 7 <> 3 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0)",
        "pattern_scan": f"WITH texts AS (SELECT 'documents' AS table_name, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, concat_ws(chr(10), url, html) FROM pages) {scan}",
        "store_range": usage(f"SELECT provider, {file_id('source_path')} AS file_id, count(*) AS records, CAST(sum(input) AS BIGINT) AS input, min(seq) AS first_seq FROM usage WHERE {inside} GROUP BY 1, 2"),
        "manifest": usage(f"""SELECT provider, {file_id('source_path')} AS file_id, count(*) AS records, CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS days, epoch_ms(min(ts)) AS min_ms, epoch_ms(max(ts)) AS max_ms,
            string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM usage GROUP BY 1, 2"""),
        "stream_deltas": f"""WITH {_COUNTERS} SELECT substr(sha256('codex' || chr(0) || 'root' || chr(0) || source_path), 1, 24) AS file_id, line_no, CASE WHEN {has_context} THEN ({_MODELS})[l_orderkey % 6 + 1] END AS model, input, cached_input, output FROM counted""",
    }


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")
