"""Queries over whole roots of turn logs, issues of logs, catalogs as a whole, clock changes and summaries that follow a stream, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timez
from ..functions.timez import resolve_range
from ..operators import ingest, pricing, rollup
from ..streaming import deltas
from . import demo, usage_queries
from .ingest_queries import _event_table, _events, _numbers, _store_path, _text, streamed_deltas, turn_lines
from .rate_queries import _rules
from .refresh import Root, refresh
from .source_queries import YEAR, write_named
from .summary import rollups_of

_ZONE = "America/New_York"
_JANUARY = resolve_range("custom", usage_queries._NOW, _ZONE, "2023-12-31", "2024-01-02")


def turn_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes two roots of turn logs: one where two of ten sessions are children of others, and one that holds an event table beside a log."""
    path = _store_path(spark)
    u = F.col("user_id") % 10
    lines = turn_lines(spark, sf_dir).select(_text("s", u, "/updates.jsonl").alias("file"), F.col("event_id").alias("n"), "value")
    # Of the two children one is named by its parent's file under another folder's name, one by its folder alone.
    seeds = _events(spark, sf_dir).groupBy(u.alias("u")).agg(F.count("*").alias("n")).where("u IN (3, 6)")
    metas = seeds.select(F.when(F.col("u") == 3, "s2/subagents/x/meta.json").otherwise("s5/subagents/s6/notes.txt").alias("file"), F.col("n"), _text('{"child_session_id": "s', F.col("u"), '"}').alias("value"))
    write_named(lines.unionByName(metas), f"{path}/sessions")
    write_named(lines.where("file = 's1/updates.jsonl'").withColumn("file", F.lit("updates.jsonl")), f"{path}/table")
    _event_table(spark, sf_dir).write.parquet(f"{path}/table/session.db")
    done = refresh(spark, [Root("grok", f"{path}/sessions"), Root("grok", f"{path}/table")], f"{path}/kept", YEAR)
    sums = [F.sum(f"tokens.{t}").alias(t) for t in ("input", "output", "cache_read")]
    return done.records.groupBy("session_id", "model").agg(F.count("*").alias("records"), *sums)


def counter_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts with information but without usage, lines that are broken, and ones that are neither."""
    i, (inp, _, _) = F.col("event_id"), _numbers()
    usage = F.when(i % 5 == 0, "{}").when(i % 5 == 1, '{"total_token_usage":{}}').otherwise(_text('{"total_token_usage":{"input_tokens":', inp, "}}"))
    value = F.when(i % 11 == 0, "{broken").when(i % 11 == 1, "[]").otherwise(_text('{"type":"event_msg","payload":{"type":"token_count","info":', F.when(i % 7 == 0, "null").otherwise(usage), "}}"))
    lines = _events(spark, sf_dir).select(_text("f", F.col("user_id") % 20, ".jsonl").alias("source_path"), i.alias("line_no"), value.alias("value"))
    _, issues = ingest.ingest_counter_log(lines)
    return issues.select("severity", "code", "source_path", "line_no", "provider")


def turn_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of turn logs in which a total doesn't tell whether cached reads are part of the input, and of how many records."""
    i = F.col("event_id")
    lines = turn_lines(spark, sf_dir).select(_text("root/s", F.col("user_id"), "/updates.jsonl").alias("source_path"), i.alias("line_no"), F.when(i % 10 == 0, "{").otherwise(F.col("value")).alias("value"))
    _, issues = ingest.ingest_turn_log(lines)
    return issues.select("severity", "code", "source_path", "line_no", "n")


def clock_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by local hour over years of clock changes, with the instants at which hours and days begin."""
    ts = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * 60)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(ts.alias("event_ts"))
    hour, day = (rollup.buckets_of(kind, _ZONE) for kind in ("hour", "day"))
    found = rows.groupBy(hour[0], F.unix_seconds(hour[1]).alias("hour_s"), day[0].alias("day"), F.unix_seconds(day[1]).alias("day_s"))
    return found.agg(F.count("*").alias("orders"))


def refresh_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked refresh intervals, one a supplier, inside what is allowed."""
    asked = F.col("s_suppkey") * 977
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", deltas.interval_seconds(asked).alias("seconds"))


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog documents, one for ten rules, some without a date, without sources or without a rule, and what makes them unfit."""
    k = F.floor(F.col("ord") / 10)
    rule = F.struct("provider", "model", F.col("source_url").alias("sourceUrl"))
    rows = _rules(spark, sf_dir).groupBy(k.alias("d")).agg(F.collect_list(rule).alias("r"))
    date = F.when(F.col("d") % 5 != 0, F.when(F.col("d") % 7 == 0, "soon").otherwise("2024-01-31T00:00:00Z"))
    urls = F.when(F.col("d") % 3 != 0, F.when(F.col("d") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("https://rates.example.com"))))
    document = F.to_json(F.struct(date.alias("checkedAt"), urls.alias("sourceUrls"), F.when(F.col("d") % 11 != 0, F.col("r")).alias("rules")))
    path = f"{_store_path(spark)}/catalogs"
    write_named(rows.select(_text("c", F.col("d"), ".json").alias("file"), F.lit(0).alias("n"), document.alias("value")), path)
    found = pricing.validate_catalogs(pricing.load_catalogs(spark, path))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "problem")


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rollups of a range, with costs and sessions, from what the stream of counter logs keeps by session and hour."""
    base = _store_path(spark)
    after = deltas.session_partials(spark, f"{base}/records", f"{base}/partials", demo.rules(spark), _ZONE)
    streamed_deltas(spark, sf_dir, base, after)
    s = rollups_of(deltas.partials_in(spark.read.parquet(f"{base}/partials"), _JANUARY))
    one = F.lit(1).cast("bigint")
    parts = [
        (s.totals, "totals", F.concat(F.lit("models "), F.col("active_models").cast("string")), F.col("sessions")), (s.provider_split, "provider", F.col("provider"), F.col("sessions")),
        (s.model_split, "model", F.concat_ws("/", "provider", "model"), F.col("sessions")), (s.trend, "trend", F.col("bucket"), F.col("sessions")), (s.sessions, "session", F.concat_ws("/", "session", "model"), one),
    ]
    rows = [df.select(F.lit(kind).alias("kind"), key.alias("key"), "records", n.alias("sessions"), "input", "cached_input", "output", F.col("cost_amount").cast("double").alias("cost_amount"), "cost_note") for df, kind, key, n in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (turn_roots, counter_issues, turn_issues, clock_changes, refresh_intervals, catalog_problems, stream_summary)}


# SQL -----------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    from .ingest_queries import oracle_sql as ingest_sql

    base = ingest_sql()
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    rate = lambda m, i, c, o: f"WHEN '{m}' THEN round(input * {i} + cached_input * {c} + output * {o}, 0)"
    rates = {r["model"]: r["rates"] for r in demo.RULES if r["provider"] == "codex"}
    rates["o3-mini"] = rates["gpt-lite"]
    micros = " ".join(rate(m, *(f"CAST({r[t]} AS DECIMAL(14,8))" for t in ("input", "cached_input", "output"))) for m, r in rates.items())
    cost = "CAST(CASE WHEN count(micro) > 1 THEN round(sum(micro / 1000000), 6) ELSE sum(micro / 1000000) END AS DOUBLE) AS cost_amount, CASE WHEN count(micro) > 0 AND count(micro) < count(*) THEN 'partial' END AS cost_note"
    numbers = f"count(*) AS records, count(DISTINCT (file_id, model)) AS sessions, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(output) AS BIGINT) AS output, {cost}"
    local = f"timezone('{_ZONE}', timezone('UTC', ts))"
    return {
        "turn_roots": f"""SELECT session_id, model, count(*) AS records, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM (
              SELECT 's' || (CAST(session_id[2:] AS BIGINT) % 10) AS session_id, model, input, output, cache_read FROM ({base["turn_log"]}) WHERE CAST(session_id[2:] AS BIGINT) % 10 NOT IN (3, 6)
              UNION ALL SELECT session_id, model, input, output, cache_read FROM ({base["session_events"]})) GROUP BY 1, 2""",
        "counter_issues": """WITH e AS (SELECT event_id AS i, 'f' || (user_id % 20) || '.jsonl' AS source_path FROM events)
            SELECT 'error' AS severity, 'malformed_jsonl' AS code, source_path, i AS line_no, CAST(NULL AS VARCHAR) AS provider FROM e WHERE i % 11 = 0
            UNION ALL SELECT 'warning', 'record_not_object', source_path, i, NULL FROM e WHERE i % 11 = 1
            UNION ALL SELECT 'warning', 'missing_tokens', source_path, i, 'codex' FROM e WHERE i % 11 > 1 AND i % 7 <> 0 AND i % 5 IN (0, 1)""",
        "turn_issues": f"""WITH e AS (SELECT event_id AS i, user_id, 'root/s' || user_id || '/updates.jsonl' AS source_path, {k} AS k FROM events)
            SELECT 'error' AS severity, 'malformed_jsonl' AS code, source_path, i AS line_no, CAST(NULL AS BIGINT) AS n FROM e WHERE i % 10 = 0
            UNION ALL SELECT 'warning', 'token_convention_changed', source_path, NULL, CAST(sum(2) AS BIGINT) FROM e WHERE i % 10 <> 0 AND i % 9 <> 0 AND i % 4 = 0 GROUP BY source_path""",
        "clock_changes": f"""WITH o AS (SELECT CAST(o_orderdate AS TIMESTAMP) + to_minutes(o_orderkey % 1440) AS ts FROM orders), l AS (SELECT ts, {local} AS here FROM o)
            SELECT strftime(here, '%Y-%m-%dT%H') || CASE WHEN here - ts = to_hours(-4) THEN '-04:00' ELSE '-05:00' END AS bucket, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s, strftime(here, '%Y-%m-%d') AS day,
              CAST(epoch(timezone('{_ZONE}', date_trunc('day', here))) AS BIGINT) AS day_s, count(*) AS orders FROM l GROUP BY ALL""",
        "refresh_intervals": "SELECT s_suppkey, CAST(least(greatest(s_suppkey * 977, 30), 86400) AS BIGINT) AS seconds FROM supplier",
        "catalog_problems": """WITH d AS (SELECT DISTINCT p_partkey // 10 AS d FROM part)
            SELECT 'c' || d || '.json' AS file, 'checked_at is missing' AS problem FROM d WHERE d % 5 = 0 OR d % 7 = 0 UNION ALL SELECT 'c' || d || '.json', 'source_urls are missing' FROM d WHERE d % 3 = 0 OR d % 4 = 0
            UNION ALL SELECT 'c' || d || '.json', 'rules are missing' FROM d WHERE d % 11 = 0""",
        "stream_summary": f"""WITH r AS (SELECT *, CASE model {micros} END AS micro FROM ({base["stream_deltas"]})), p AS (SELECT 'codex' AS provider, coalesce(model, 'unknown') AS name, 'o' AS s, * FROM r), k AS ({base["counter_log"]})
            SELECT 'totals' AS kind, 'models ' || count(DISTINCT model) AS key, {numbers} FROM p
            UNION ALL SELECT 'provider', provider, {numbers} FROM p GROUP BY provider
            UNION ALL SELECT 'provider', x, 0, 0, NULL, NULL, NULL, NULL, NULL FROM (VALUES ('claude'), ('pi'), ('grok')) AS v(x)
            UNION ALL SELECT 'model', provider || '/' || name, {numbers} FROM p GROUP BY provider, name
            UNION ALL SELECT 'trend', '2023-12-31', {numbers} FROM p
            UNION ALL SELECT 'session', session_id || '/' || coalesce(model, 'unknown'), count(*), 1, CAST(sum(input) AS BIGINT), CAST(sum(cached_input) AS BIGINT), CAST(sum(output) AS BIGINT), {cost}
              FROM (SELECT *, CASE model {micros} END AS micro FROM k) GROUP BY session_id, model""",
    }
