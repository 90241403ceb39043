"""Queries over usage records derived from `events`, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.timez import TimeRange, duration_minutes, duration_text, literal, resolve_range
from ..operators import currency, filters, pricing, rollup
from ..schema import PROVIDERS, TOKENS
from . import demo

TAIPEI, NEW_YORK = "Asia/Taipei", "America/New_York"
_NOW = datetime(2024, 1, 17, 12, tzinfo=timezone.utc)
MONTH = resolve_range("thisMonth", _NOW, TAIPEI)
TWO_DAYS = resolve_range("custom", _NOW, NEW_YORK, "2024-01-08", "2024-01-09")
EUR = currency.Display("EUR", "EUR", 0.92, "manual")


def _priced(spark: SparkSession, sf_dir: str, span: TimeRange | None = None) -> DataFrame:
    records = demo.usage_from_events(spark, sf_dir)
    rules = demo.rules(spark)
    kept = filters.in_range(records, span) if span else records
    return pricing.price(kept, pricing.rate_book(rules), pricing.catalog_is_valid(rules))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    """The columns that SQL states too; money as double after exact decimal rounding."""
    wanted = [*keys, "records", *(["sessions"] if "sessions" in df.columns else []), *TOKENS]
    return df.select(*wanted, F.col("cost_amount").cast("double").alias("cost_amount"), "cost_currency", "cost_source", "cost_note")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.totals(_priced(spark, sf_dir, MONTH)), "active_models")


def provider_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.provider_split(_priced(spark, sf_dir, TWO_DAYS).where("provider <> 'pi'")), "provider")


def model_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.model_split(_priced(spark, sf_dir, MONTH)), "provider", "model")


def trend_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.trend(_priced(spark, sf_dir, MONTH), MONTH), "bucket")


def trend_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.trend(_priced(spark, sf_dir, TWO_DAYS), TWO_DAYS)
    return _flat(found.withColumn("start_s", F.unix_seconds("bucket_start")), "bucket", "start_s")


def _session_columns(df: DataFrame) -> DataFrame:
    return _flat(df.withColumns({"started_ms": F.unix_millis("started_at"), "ended_ms": F.unix_millis("ended_at")}), "provider", "session", "model", "started_ms", "ended_ms")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_columns(rollup.sessions(_priced(spark, sf_dir)))


def top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_columns(rollup.top_sessions(rollup.sessions(_priced(spark, sf_dir)), 60))


def session_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = duration_minutes(F.col("started_at"), F.col("ended_at"))
    return rollup.sessions(_priced(spark, sf_dir)).select("provider", "session", "model", minutes.alias("minutes"), duration_text(minutes).alias("duration"))


def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(rollup.top_models(rollup.model_split(_priced(spark, sf_dir)), 12), "provider", "model")


def cost_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.cost_by_currency(rollup.sessions(_priced(spark, sf_dir)))
    return found.select("currency", F.col("cost_amount").cast("double").alias("cost_amount"), "parts")


def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.active_models(demo.usage_from_events(spark, sf_dir))


def priced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("seq", F.col("cost.amount").cast("double").alias("amount"), F.col("cost.currency").alias("currency"), F.col("cost.source").alias("source"), "cost_reason")


def cost_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).groupBy("provider", F.coalesce("cost_reason", F.lit("priced")).alias("reason")).agg(F.count("*").alias("records"))


def matched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = pricing.rate_book(demo.rules(spark))
    return pricing.matched(demo.usage_from_events(spark, sf_dir), book).select("seq", F.col("_rule.ord").alias("rule"))


def rate_varies(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = rollup.model_split(_priced(spark, sf_dir, MONTH)).select("provider", "model")
    return pricing.rate_varies(split, pricing.rate_book(demo.rules(spark)), literal(MONTH.start), literal(MONTH.end))


def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.derived_metrics(rollup.model_split(_priced(spark, sf_dir)))
    return found.select("provider", "model", "token_total", "cache_create", "cache_read_all", *[F.round(c, 9).alias(c) for c in ("cache_rate", "cache_ratio", "tokens_per_record")], F.round("cost_per_record", 6).alias("cost_per_record"))


def provider_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.provider_share(rollup.provider_split(_priced(spark, sf_dir))).select("provider", "records", F.round("share", 9).alias("share"))


def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trend_series(rollup.trend(_priced(spark, sf_dir, MONTH), MONTH)).select("bucket", "metric", F.round("value", 6).alias("value"))


def display_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of sessions: those in USD converted, those in other currencies as they are, none where a session mixes them."""
    found = currency.convert_cost(rollup.sessions(_priced(spark, sf_dir)), EUR)
    return found.select("provider", "session", "model", "records", F.round("cost_amount", 6).alias("cost_amount"), "cost_currency")


def one_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.for_provider(filters.in_range(demo.usage_from_events(spark, sf_dir), TWO_DAYS), "codex")
    return found.select("seq", "model", F.col("tokens.input").alias("input"), metrics.token_total(F.col("tokens")).alias("token_total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "totals": totals, "provider_split": provider_split, "model_split": model_split, "trend_day": trend_day, "trend_hour": trend_hour,
        "sessions": sessions, "top_sessions": top_sessions, "session_durations": session_durations, "top_models": top_models,
        "cost_by_currency": cost_by_currency, "active_models": active_models, "priced_records": priced_records, "cost_reasons": cost_reasons,
        "matched_rules": matched_rules, "rate_varies": rate_varies, "derived_metrics": derived_metrics, "provider_share": provider_share,
        "trend_series": trend_series, "display_currency": display_currency, "one_provider": one_provider,
    }


# SQL -----------------------------------------------------------------------


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rates_sql() -> str:
    rows = []
    for i, r in enumerate(demo.RULES):
        number = lambda d, t: f"CAST({d[t]} AS DECIMAL(14,8))" if d and t in d else "CAST(NULL AS DECIMAL(14,8))"
        for name in [r["model"].lower(), *r["aliases"]]:
            when = [f"TIMESTAMP '{r.get(k) or x}'" for k, x in (("effective_from", "0001-01-01"), ("effective_to", "9999-12-31"))]
            rows.append(f"('{r['provider']}', '{name}', {', '.join(when)}, {i}, {', '.join(number(r['rates'], t) for t in TOKENS)}, {r.get('threshold', 'NULL')}, {', '.join(number(r.get('long_rates'), t) for t in TOKENS)})")
    return ",\n    ".join(rows)


_R, _LR = [f"r{i}" for i in range(6)], [f"l{i}" for i in range(6)]
USAGE_SQL = f"""
usage AS (
  SELECT event_id AS seq, ({_list(PROVIDERS)})[event_id % 4 + 1] AS provider,
    CASE WHEN event_id % 17 <> 0 THEN ({_list(demo.MODELS)})[(user_id + event_id % 3) % 6 + 1] END AS model,
    CASE WHEN event_id % 23 <> 0 THEN 's' || user_id END AS session_id, 'f' || (user_id % 10) AS source_path,
    date_trunc('millisecond', ts) AS ts, CAST(floor(value * 1000) AS BIGINT) AS input, CAST(floor(value * 100) AS BIGINT) AS output,
    CASE WHEN event_id % 4 IN (1, 3) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 END AS cached_input,
    CASE WHEN event_id % 4 IN (0, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 END AS cache_read,
    CAST(NULL AS BIGINT) AS cache_write_5m, CAST(NULL AS BIGINT) AS cache_write_1h,
    CASE WHEN event_type = 'purchase' THEN CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,10)) END AS imported,
    CASE WHEN event_id % 1000 = 0 THEN 'EUR' ELSE 'USD' END AS imported_currency, event_id % 101 = 0 AS ambiguous
  FROM events
), rates(provider, name, vf, vt, ord, {', '.join(_R)}, threshold, {', '.join(_LR)}) AS (
  VALUES {_rates_sql()}
), book AS (
  SELECT * FROM rates UNION ALL
  SELECT 'pi' AS provider, * EXCLUDE (provider) FROM rates
  WHERE ((provider = 'claude' AND name LIKE 'claude%') OR (provider = 'codex' AND regexp_matches(name, '^(gpt|o[0-9])')) OR (provider = 'grok' AND name LIKE 'grok%'))
    AND name NOT IN (SELECT name FROM rates WHERE provider = 'pi')
), matched AS (
  SELECT u.*, b.* EXCLUDE (provider, name)
  FROM usage u LEFT JOIN (
    SELECT u.seq AS s, b.*, row_number() OVER (PARTITION BY u.seq ORDER BY b.vf DESC, b.ord) AS n
    FROM usage u JOIN book b ON b.provider = u.provider AND b.name = lower(u.model) AND u.ts >= b.vf AND u.ts < b.vt
  ) b ON b.s = u.seq AND b.n = 1
), counted AS (
  SELECT *, CASE WHEN r2 IS NOT NULL AND r3 IS NULL THEN coalesce(cached_input, 0) + coalesce(cache_read, 0) WHEN r3 IS NOT NULL AND r2 IS NULL THEN NULL ELSE cached_input END AS c2,
    CASE WHEN r3 IS NOT NULL AND r2 IS NULL THEN coalesce(cached_input, 0) + coalesce(cache_read, 0) WHEN r2 IS NOT NULL AND r3 IS NULL THEN NULL ELSE cache_read END AS c3
  FROM matched
), amounts AS (
  SELECT *, coalesce(input, 0) + coalesce(c2, 0) > threshold AS long_context FROM counted
), micros AS (
  SELECT *, round({' + '.join(f"coalesce(CAST({c} AS DECIMAL(16,0)) * CASE WHEN long_context THEN l{i} ELSE r{i} END, 0)" for i, c in enumerate(["input", "output", "c2", "c3", "cache_write_5m", "cache_write_1h"]))}, 0) AS micro FROM amounts
), priced AS (
  SELECT *, CASE WHEN imported IS NOT NULL THEN NULL WHEN ambiguous THEN 'ambiguous_tokens' WHEN model IS NULL THEN 'unknown_model'
      WHEN coalesce(input, 0) + coalesce(output, 0) + coalesce(cached_input, 0) + coalesce(cache_read, 0) = 0 THEN 'missing_tokens'
      WHEN ord IS NULL THEN 'unknown_model' WHEN micro = 0 THEN 'missing_tokens' END AS cost_reason,
    CASE WHEN imported IS NOT NULL THEN imported WHEN cost_reason IS NULL THEN CAST(CAST(micro AS DECIMAL(32,6)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(38,10)) END AS amount,
    CASE WHEN imported IS NOT NULL THEN imported_currency WHEN cost_reason IS NULL THEN 'USD' END AS currency,
    CASE WHEN imported IS NOT NULL THEN 'imported' WHEN cost_reason IS NULL THEN 'calculated' END AS source,
    coalesce(session_id, source_path) AS session, coalesce(model, 'unknown') AS model_name
  FROM micros
)"""
_TOKEN_SUMS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in TOKENS)
_ONE = "count(amount) > 0 AND min(currency) = max(currency)"
_COSTS = f"""CAST(CASE WHEN {_ONE} THEN CASE WHEN count(amount) > 1 THEN round(sum(amount), 6) ELSE sum(amount) END END AS DOUBLE) AS cost_amount,
  CASE WHEN {_ONE} THEN min(currency) END AS cost_currency, CASE WHEN {_ONE} THEN min(source) END AS cost_source,
  CASE WHEN {_ONE} AND count(amount) < count(*) THEN 'partial' END AS cost_note"""
_SESSIONS = "count(DISTINCT (provider, session, model_name)) AS sessions"
_ALL = f"count(*) AS records, {_SESSIONS}, {_TOKEN_SUMS}, {_COSTS}"


def _inside(span: TimeRange) -> str:
    text = lambda t: t.strftime("%Y-%m-%d %H:%M:%S.%f")
    return f"ts BETWEEN TIMESTAMP '{text(span.start)}' AND TIMESTAMP '{text(span.end)}'"


def with_usage(select: str) -> str:
    return f"WITH {USAGE_SQL}\n{select}"


def _local(zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', ts))"


_SESSION_ROLLUP = f"""SELECT provider, session, model_name AS model, epoch_ms(min(ts)) AS started_ms, epoch_ms(max(ts)) AS ended_ms,
  count(*) AS records, {_TOKEN_SUMS}, {_COSTS} FROM priced GROUP BY provider, session, model_name"""
_MODEL_SPLIT = f"SELECT provider, model_name AS model, {_ALL} FROM priced"


def oracle_sql() -> dict[str, str]:
    total = "coalesce(input, 0) + coalesce(output, 0) + coalesce(cached_input, 0) + coalesce(cache_read, 0)"
    read = "coalesce(cached_input, 0) + coalesce(cache_read, 0)"
    day = f"SELECT strftime({_local(TAIPEI)}, '%Y-%m-%d') AS bucket, {_ALL} FROM priced WHERE {_inside(MONTH)} GROUP BY 1"
    minutes = "(ended_ms - started_ms) // 60000"
    return {
        k: with_usage(v)
        for k, v in {
            "totals": f"SELECT {_ALL}, count(DISTINCT model) AS active_models FROM priced WHERE {_inside(MONTH)}",
            "provider_split": f"""SELECT p.provider, coalesce(s.records, 0) AS records, coalesce(s.sessions, 0) AS sessions, s.* EXCLUDE (provider, records, sessions)
                FROM (SELECT unnest({_list(PROVIDERS)}) AS provider) p LEFT JOIN (
                  SELECT provider, {_ALL} FROM priced WHERE {_inside(TWO_DAYS)} AND provider <> 'pi' GROUP BY provider) s ON s.provider = p.provider""",
            "model_split": f"{_MODEL_SPLIT} WHERE {_inside(MONTH)} GROUP BY provider, model_name",
            "trend_day": day,
            "trend_hour": f"""SELECT strftime({_local(NEW_YORK)}, '%Y-%m-%dT%H') || '-05:00' AS bucket, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, {_ALL}
                FROM priced WHERE {_inside(TWO_DAYS)} GROUP BY 1, 2""",
            "sessions": _SESSION_ROLLUP,
            "top_sessions": f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY started_ms DESC, session, model) AS n FROM ({_SESSION_ROLLUP})) WHERE n <= 60""",
            "session_durations": f"""SELECT provider, session, model, m AS minutes, CASE WHEN m < 1 THEN '<1m'
                  WHEN m >= 1440 THEN (m // 1440) || 'd' || CASE WHEN m // 60 % 24 > 0 THEN ' ' || (m // 60 % 24) || 'h' ELSE '' END
                  ELSE concat_ws(' ', CASE WHEN m >= 60 THEN (m // 60) || 'h' END, CASE WHEN m % 60 > 0 THEN (m % 60) || 'm' END) END AS duration
                FROM (SELECT *, {minutes} AS m FROM ({_SESSION_ROLLUP}))""",
            "top_models": f"{_MODEL_SPLIT} GROUP BY provider, model_name ORDER BY records DESC, provider, model LIMIT 12",
            "cost_by_currency": f"""SELECT cost_currency AS currency, CAST(sum(c) AS DOUBLE) AS cost_amount, count(*) AS parts FROM (
                SELECT min(currency) AS cost_currency, CASE WHEN count(amount) > 1 THEN round(sum(amount), 6) ELSE sum(amount) END AS c
                FROM priced GROUP BY provider, session, model_name HAVING {_ONE}) GROUP BY 1""",
            "active_models": "SELECT DISTINCT model FROM usage WHERE model IS NOT NULL",
            "priced_records": "SELECT seq, CAST(amount AS DOUBLE) AS amount, currency, source, cost_reason FROM priced",
            "cost_reasons": "SELECT provider, coalesce(cost_reason, 'priced') AS reason, count(*) AS records FROM priced GROUP BY 1, 2",
            "matched_rules": "SELECT seq, ord AS rule FROM matched",
            "rate_varies": f"""SELECT DISTINCT provider, model_name AS model, provider IN ('claude', 'pi') AND model_name = 'claude-deep' AS rate_varies FROM priced WHERE {_inside(MONTH)}""",
            "derived_metrics": f"""SELECT provider, model_name AS model, CAST(sum({total}) AS BIGINT) AS token_total, CAST(0 AS BIGINT) AS cache_create, CAST(sum({read}) AS BIGINT) AS cache_read_all,
                  round(CASE WHEN sum(input + {read}) > 0 THEN sum({read}) / sum(input + {read}) END, 9) AS cache_rate, round(CASE WHEN sum({total}) > 0 THEN sum({read}) / sum({total}) ELSE 0 END, 9) AS cache_ratio,
                  round(sum({total}) / count(*), 9) AS tokens_per_record,
                  round(CAST(CASE WHEN {_ONE} THEN round(sum(amount), 6) END AS DOUBLE) / count(*), 6) AS cost_per_record
                FROM priced GROUP BY provider, model_name""",
            "provider_share": "SELECT provider, count(*) AS records, round(count(*) / (SELECT count(*) FROM priced), 9) AS share FROM priced GROUP BY provider",
            "trend_series": f"""SELECT bucket, m.metric, round(m.value, 6) AS value FROM ({day}), LATERAL (VALUES ('cost', coalesce(cost_amount, 0)), ('records', CAST(records AS DOUBLE)),
                ('input', CAST(input AS DOUBLE)), ('output', CAST(output AS DOUBLE)), ('cache_create', CAST(0 AS DOUBLE)), ('cache_read', CAST({read} AS DOUBLE))) AS m(metric, value)""",
            "display_currency": f"""SELECT provider, session, model, records, round(CASE WHEN cost_currency = 'USD' THEN cost_amount * 0.92 ELSE cost_amount END, 6) AS cost_amount,
                CASE WHEN cost_currency = 'USD' THEN 'EUR' ELSE cost_currency END AS cost_currency FROM ({_SESSION_ROLLUP})""",
            "one_provider": f"SELECT seq, model, input, {total} AS token_total FROM usage WHERE provider = 'codex' AND {_inside(TWO_DAYS)}",
        }.items()
    }
