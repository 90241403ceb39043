"""Queries over catalogs of rates, currencies, summaries and running rollups, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import add_days, day_bucket, resolve_range, resolve_zone
from ..operators import currency, filters, pricing, rollup
from ..schema import PROVIDERS, RATE_TYPE, TOKENS
from ..sources import store
from ..streaming import deltas
from . import demo, usage_queries
from .ingest_queries import _store_path, _text, streamed_deltas
from .source_queries import write_named
from .summary import summarise


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part: three for a model, one after the other, with faults at fixed places."""
    k = F.col("k")
    g, j = F.floor(k / 3), k % 3
    day = lambda text: F.lit(text).cast("timestamp")
    rates = lambda times, odd: F.struct(*[{"input": k * 0.25 * times, "output": F.when(odd, F.lit(None)).otherwise(F.when(k % 13 == 0, -1).otherwise(k) * times)}.get(t, F.lit(None)).cast(RATE_TYPE).alias(t) for t in TOKENS])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")).select(
        F.get(F.array(*map(F.lit, PROVIDERS)), (g % 4).cast("int")).alias("provider"), _text("M", g).alias("model"), F.array(F.when((j == 2) & (g % 11 == 0), _text("b", g)).otherwise(_text("a", g))).alias("aliases"),
        F.lit("USD").alias("currency"), F.lit("1M tokens").alias("price_unit"), F.when(k % 19 == 0, " ").otherwise(_text("https://rates.example.com/", k)).alias("source_url"), F.when(k % 17 != 0, day("2024-01-31")).alias("checked_at"),
        F.when((j == 1) & (g % 23 == 0), day("2024-01-25")).when(j == 1, day("2024-01-10")).when(j == 2, day("2024-01-20")).alias("effective_from"),
        F.when(j == 0, day("2024-01-10")).when((j == 1) & (g % 5 == 0), day("2024-01-19")).when(j == 1, day("2024-01-20")).when(g % 7 == 0, day("2024-03-01")).alias("effective_to"),
        rates(1, F.lit(False)).alias("rates"), F.when(k % 8 == 0, 199999).when(k % 4 == 0, 272000).cast("bigint").alias("threshold"), F.when((k % 4 == 0) & (k % 28 != 0), rates(2, k % 20 == 0)).alias("long_rates"), k.cast("int").alias("ord"),
    )


def loaded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog documents of 300 rules each, written as files and read back."""
    k = F.col("ord")
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.input").cast("double").alias("input"), F.col(f"{c}.output").cast("double").alias("output")))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rule = F.struct(
        "provider", "model", F.col("aliases").alias("modelAliases"), "currency", F.col("price_unit").alias("priceUnit"), F.col("source_url").alias("sourceUrl"), iso("checked_at").alias("checkedAt"), iso("effective_from").alias("effectiveFrom"),
        iso("effective_to").alias("effectiveTo"), named("rates").alias("rates"), F.when(F.col("long_rates").isNotNull(), F.struct(F.col("threshold").alias("appliesAboveInputTokens"), named("long_rates").alias("rates"))).alias("longContext"),
    )
    documents = _rules(spark, sf_dir).groupBy(F.floor(k / 300).alias("d")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", rule.alias("rule")))), lambda x: x["rule"]).alias("rules"))).alias("value"))
    path = f"{_store_path(spark)}/catalogs"
    write_named(documents.select(_text("c", F.col("d"), ".json").alias("file"), F.lit(0).alias("n"), "value"), path)
    rows = pricing.load_rates(spark, path)
    return rows.select("ord", "provider", "model", F.array_join("aliases", ",").alias("aliases"), F.unix_seconds("effective_from").alias("from_s"), F.unix_seconds("effective_to").alias("to_s"), F.col("rates.input").cast("double").alias("input"), F.col("rates.output").cast("double").alias("output"), "threshold", F.col("long_rates.input").cast("double").alias("long_input"))


def rate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.validate_rates(_rules(spark, sf_dir)).select("ord", "model", "problem")


def rate_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.lint_rates(_rules(spark, sf_dir)).select("ord", "model", "problem")


def rate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.rate_sheet(_rules(spark, sf_dir)).select("ord", "provider", "model", "source_host", "tier", "context", "category_ord", "category", F.col("rate").cast("double").alias("rate"))


def converted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = currency.convert_rates(_rules(spark, sf_dir), usage_queries.EUR)
    return found.select("ord", "currency", F.round("rates.input", 6).alias("input"), F.round("rates.output", 6).alias("output"), F.round("long_rates.input", 6).alias("long_input"))


def _fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A public document with a code for each nation; some codes and rates are not usable."""
    k = F.col("n_nationkey")
    code = F.when(k % 8 == 7, _text("LONG", k)).otherwise(F.concat(F.lit("Q"), F.chr(k + 65), F.lit("X")))
    rates = F.map_from_entries(F.concat(F.array(F.struct(F.lit("USD").alias("code"), F.lit(1.0).alias("rate"))), F.collect_list(F.struct(code.alias("code"), (k - 2).cast("double").alias("rate")))))
    payload = F.struct(F.lit("success").alias("result"), F.lit("USD").alias("base_code"), F.lit("Fri, 05 Jan 2024 00:00:01 +0000").alias("time_last_update_utc"), rates.alias("rates"))
    return currency.fx_from_payload(spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.to_json(payload).alias("value")))


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fx(spark, sf_dir).select("code", "rate", "source", F.unix_seconds("updated_at").alias("updated_s"))


def display_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of sessions in three currencies: one with a public rate, one with a manual one, one without a rate. Those not in USD stay."""
    fx = _fx(spark, sf_dir)
    split = rollup.sessions(usage_queries._priced(spark, sf_dir)).select("provider", "session", "model", "cost_amount", "cost_currency")
    shown = [currency.resolve_currency(code, {"qfx": "7.5"}, fx) for code in ("qgx", "QFX", "XXX")]
    manual = spark.createDataFrame([(d.code, d.rate) for d in shown if d.source == "manual"], "code string, rate double")
    table = fx.select("code", "rate").where(~F.col("code").isin([d.code for d in shown if d.source == "manual"])).unionByName(manual)
    parts = [currency.convert_by_table(split, table, d.code).withColumn("asked", F.lit(d.requested)) for d in shown]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("asked", "provider", "session", "model", currency.shown(F.col("cost_amount")).alias("cost_amount"), "cost_currency")


def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = demo.usage_from_events(spark, sf_dir).select(F.col("imported_cost.currency").alias("code"))
    return rollup.currency_codes(spark, _fx(spark, sf_dir), _rules(spark, sf_dir).select(F.col("currency").alias("code")), used)


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two importers under one another, repeated ones too."""
    one = demo.usage_from_events(spark, sf_dir)
    return filters.for_provider(one.unionByName(one.where("provider <> 'pi'")), "all").groupBy("provider").agg(F.count("*").alias("records"))


def zoned_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by local day of a week that is reckoned from a day key, in the zones of four settings."""
    first = "2024-01-08"
    parts = []
    for mode, custom in (("utc", None), ("custom", "Asia/Taipei"), ("custom", "Nowhere/Land"), ("system", "Asia/Taipei")):
        zone = resolve_zone(mode, custom, system="America/New_York")
        span = resolve_range("custom", datetime(2024, 1, 17, tzinfo=timezone.utc), zone, first, add_days(first, 6))
        days = filters.in_range(demo.usage_from_events(spark, sf_dir), span).groupBy(day_bucket(F.col("event_ts"), zone).alias("day"))
        parts.append(days.agg(F.count("*").alias("records")).withColumn("setting", F.lit(f"{mode} {custom}")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rollups of a month in one long table."""
    s = summarise(demo.usage_from_events(spark, sf_dir), usage_queries.MONTH, demo.rules(spark))
    one = F.lit(1).cast("bigint")
    parts = [
        (s.totals, F.lit("totals"), F.concat(F.lit("models "), F.col("active_models").cast("string")), F.col("sessions")),
        (s.provider_split, F.lit("provider"), F.col("provider"), F.col("sessions")),
        (s.model_split, F.lit("model"), F.concat_ws("/", "provider", "model"), F.col("sessions")),
        (s.trend, F.lit("trend"), F.col("bucket"), F.col("sessions")),
        (s.sessions, F.lit("session"), F.concat_ws("/", "provider", "session", "model", F.unix_millis("started_at"), F.unix_millis("ended_at")), one),
    ]
    rows = [df.select(kind.alias("kind"), key.alias("key"), "records", n.alias("sessions"), "input", "cached_input", F.col("cost_amount").cast("double").alias("cost_amount"), "cost_currency", "cost_source", "cost_note") for df, kind, key, n in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rollups kept up to date by the stream of counter logs."""
    base = _store_path(spark)
    streamed_deltas(spark, sf_dir, base, deltas.daily_rollup(spark, f"{base}/records", f"{base}/daily"))
    return spark.read.parquet(f"{base}/daily").select("provider", F.col("utc_date").cast("string").alias("utc_date"), F.coalesce("model", F.lit("unknown")).alias("model"), "records", "input", "cached_input", "output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (loaded_rates, rate_problems, rate_lint, rate_sheet, converted_rates, fx_rates, display_by_table, currency_codes, all_records, zoned_days, summary, stream_daily)
    return {f.__name__: f for f in found}


# SQL -----------------------------------------------------------------------

_RULES = f"""r AS (
  SELECT p_partkey AS k, p_partkey // 3 AS g, p_partkey % 3 AS j, CAST(p_partkey AS INTEGER) AS ord, 'M' || (p_partkey // 3) AS model, ({usage_queries._list(PROVIDERS)})[p_partkey // 3 % 4 + 1] AS provider,
    CASE WHEN p_partkey % 3 = 2 AND p_partkey // 3 % 11 = 0 THEN 'b' ELSE 'a' END || (p_partkey // 3) AS aliases,
    CASE WHEN p_partkey % 3 = 1 AND p_partkey // 3 % 23 = 0 THEN TIMESTAMP '2024-01-25' WHEN p_partkey % 3 = 1 THEN TIMESTAMP '2024-01-10' WHEN p_partkey % 3 = 2 THEN TIMESTAMP '2024-01-20' END AS vf,
    CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-10' WHEN p_partkey % 3 = 1 AND p_partkey // 3 % 5 = 0 THEN TIMESTAMP '2024-01-19' WHEN p_partkey % 3 = 1 THEN TIMESTAMP '2024-01-20' WHEN p_partkey // 3 % 7 = 0 THEN TIMESTAMP '2024-03-01' END AS vt,
    p_partkey * 0.25 AS input, CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_partkey END AS output, p_partkey % 4 = 0 AND p_partkey % 28 <> 0 AS long_,
    CASE WHEN p_partkey % 8 = 0 THEN 199999 WHEN p_partkey % 4 = 0 THEN 272000 END AS threshold
  FROM part)"""
_FX = "fx AS (SELECT 'Q' || chr(n_nationkey + 65) || 'X' AS code, CAST(n_nationkey - 2 AS DOUBLE) AS rate FROM nation WHERE n_nationkey > 2 AND n_nationkey % 8 <> 7 UNION ALL SELECT 'USD', 1.0)"


def oracle_sql() -> dict[str, str]:
    from .ingest_queries import oracle_sql as ingest_sql

    usage = usage_queries.with_usage
    inside = usage_queries._inside(usage_queries.MONTH)
    numbers = f"count(*) AS records, {usage_queries._SESSIONS}, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached_input) AS BIGINT) AS cached_input, {usage_queries._COSTS}"
    day = f"strftime({usage_queries._local(usage_queries.TAIPEI)}, '%Y-%m-%d')"
    week = lambda zone, setting: f"SELECT '{setting}' AS setting, CAST(CAST(timezone('{zone}', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, count(*) AS records FROM usage WHERE CAST(timezone('{zone}', timezone('UTC', ts)) AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 2"
    return {
        "loaded_rates": f"""WITH {_RULES} SELECT CAST(k % 300 AS INTEGER) AS ord, provider, model, aliases, CAST(epoch(vf) AS BIGINT) AS from_s, CAST(epoch(vt) AS BIGINT) AS to_s, CAST(input AS DOUBLE) AS input, CAST(output AS DOUBLE) AS output,
            CASE WHEN long_ THEN CAST(threshold AS BIGINT) END AS threshold, CASE WHEN long_ THEN CAST(input * 2 AS DOUBLE) END AS long_input FROM r""",
        "rate_problems": f"""WITH {_RULES} SELECT ord, model, 'checked_at is missing' AS problem FROM r WHERE k % 17 = 0 UNION ALL SELECT ord, model, 'source_url is missing' FROM r WHERE k % 19 = 0
            UNION ALL SELECT ord, model, 'effective_from is not before effective_to' FROM r WHERE vf >= vt UNION ALL SELECT ord, model, 'threshold and long rates need each other' FROM r WHERE k % 28 = 0
            UNION ALL SELECT ord, model, 'long rates name other categories' FROM r WHERE long_ AND k % 20 = 0 UNION ALL SELECT ord, model, 'a rate is negative' FROM r WHERE k % 13 = 0""",
        "rate_lint": f"""WITH {_RULES}, w AS (SELECT *, lag(vt) OVER m AS prev, row_number() OVER m AS n, count(*) OVER (PARTITION BY g) AS size, min(aliases) OVER (PARTITION BY g) AS a0, max(aliases) OVER (PARTITION BY g) AS a1
              FROM r WINDOW m AS (PARTITION BY g ORDER BY vf NULLS FIRST, ord))
            SELECT ord, model, 'checked_at is missing' AS problem FROM r WHERE k % 17 = 0 UNION ALL SELECT ord, model, 'does not follow the rule before' FROM w WHERE size > 1 AND n > 1 AND prev IS DISTINCT FROM vf
            UNION ALL SELECT ord, model, 'last rule is not open' FROM w WHERE size > 1 AND n = size AND vt IS NOT NULL UNION ALL SELECT ord, model, 'aliases differ between dates' FROM w WHERE size > 1 AND n = 1 AND a0 <> a1""",
        "rate_sheet": f"""WITH {_RULES}, t AS (
              SELECT *, 'base' AS tier, 1 AS f, CASE threshold WHEN 199999 THEN '<200K' WHEN 272000 THEN '≤272K' END AS context, TRUE AS whole FROM r
              UNION ALL SELECT *, 'long', 2, CASE threshold WHEN 199999 THEN '≥200K' ELSE '>272K' END, k % 20 <> 0 FROM r WHERE long_)
            SELECT ord, provider, model, CASE WHEN k % 19 <> 0 THEN 'rates.example.com' END AS source_host, tier, context, c.category_ord, c.category, CAST(c.rate AS DOUBLE) AS rate
            FROM t, LATERAL (VALUES (0, 'input', input * f), (1, 'output', CASE WHEN whole THEN output * f END)) AS c(category_ord, category, rate) WHERE c.rate IS NOT NULL""",
        "converted_rates": f"WITH {_RULES} SELECT ord, 'EUR' AS currency, round(CAST(input AS DOUBLE) * 0.92, 6) AS input, round(CAST(output AS DOUBLE) * 0.92, 6) AS output, CASE WHEN long_ THEN round(CAST(input * 2 AS DOUBLE) * 0.92, 6) END AS long_input FROM r",
        "fx_rates": f"WITH {_FX} SELECT code, rate, 'public' AS source, CAST(epoch(TIMESTAMP '2024-01-05 00:00:01') AS BIGINT) AS updated_s FROM fx",
        "display_by_table": usage(f"""SELECT asked, provider, session, model, round(CASE WHEN cost_currency = 'USD' THEN cost_amount * CAST(rate AS DOUBLE) ELSE cost_amount END, 6) AS cost_amount,
            CASE WHEN cost_currency = 'USD' THEN code ELSE cost_currency END AS cost_currency FROM ({usage_queries._SESSION_ROLLUP}), (VALUES ('QGX', 'QGX', 4.0), ('QFX', 'QFX', 7.5), ('XXX', 'USD', 1.0)) AS x(asked, code, rate)"""),
        "currency_codes": f"WITH {_FX} SELECT code FROM fx UNION SELECT CASE WHEN event_id % 1000 = 0 THEN 'EUR' ELSE 'USD' END FROM events WHERE event_type = 'purchase'",
        "all_records": usage("SELECT provider, count(*) * CASE WHEN provider = 'pi' THEN 1 ELSE 2 END AS records FROM usage GROUP BY provider"),
        "zoned_days": usage(" UNION ALL ".join(week(z, s) for z, s in (("UTC", "utc None"), ("Asia/Taipei", "custom Asia/Taipei"), ("America/New_York", "custom Nowhere/Land"), ("America/New_York", "system Asia/Taipei")))),
        "summary": usage(f"""SELECT 'totals' AS kind, 'models ' || count(DISTINCT model) AS key, {numbers} FROM priced WHERE {inside}
            UNION ALL SELECT 'provider', provider, {numbers} FROM priced WHERE {inside} GROUP BY provider
            UNION ALL SELECT 'model', provider || '/' || model_name, {numbers} FROM priced WHERE {inside} GROUP BY provider, model_name
            UNION ALL SELECT 'trend', {day}, {numbers} FROM priced WHERE {inside} GROUP BY 2
            UNION ALL SELECT 'session', concat_ws('/', provider, session, model_name, epoch_ms(min(ts)), epoch_ms(max(ts))), {numbers} FROM priced WHERE {inside} GROUP BY provider, session, model_name"""),
        "stream_daily": f"""SELECT 'codex' AS provider, '2024-01-01' AS utc_date, coalesce(model, 'unknown') AS model, count(*) AS records, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(output) AS BIGINT) AS output
            FROM ({ingest_sql()["stream_deltas"]}) GROUP BY 3""",
    }
