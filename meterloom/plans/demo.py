"""Usage records derived from the test tables, so that Spark and SQL can both state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROVIDERS, as_records, tokens_struct

MODELS = ("claude-sonic", "claude-deep", "gpt-lite", "gpt-max", "o3-mini", "grok-core")
#: A small catalog. The rates are made up and meant to be no vendor's.
RULES = (
    {"provider": "claude", "model": "Claude-Sonic", "aliases": ["claude-sonic-latest"], "rates": {"input": 2.7, "output": 13.9, "cache_read": 0.31, "cache_write_5m": 3.3, "cache_write_1h": 5.3}},
    {"provider": "claude", "model": "claude-deep", "aliases": [], "effective_to": "2024-01-10 00:00:00", "rates": {"input": 11.3, "output": 57.7, "cache_read": 1.17}},
    {"provider": "claude", "model": "claude-deep", "aliases": [], "effective_from": "2024-01-10 00:00:00", "effective_to": "2024-01-20 00:00:00", "rates": {"input": 9.1, "output": 46.3, "cache_read": 0.93}},
    {"provider": "claude", "model": "claude-deep", "aliases": [], "effective_from": "2024-01-20 00:00:00", "rates": {"input": 7.7, "output": 39.1, "cache_read": 0.79}},
    {"provider": "codex", "model": "gpt-lite", "aliases": ["o3-mini"], "rates": {"input": 0.37, "output": 2.3, "cached_input": 0.041}},
    {"provider": "codex", "model": "gpt-max", "aliases": [], "rates": {"input": 4.3, "output": 27.1, "cached_input": 0.47}, "threshold": 60000, "long_rates": {"input": 8.9, "output": 41.3, "cached_input": 0.97}},
    {"provider": "grok", "model": "grok-core", "aliases": ["grok"], "rates": {"input": 1.9, "output": 9.7, "cached_input": 0.43}},
    {"provider": "pi", "model": "grok-core", "aliases": [], "rates": {"input": 1.3, "output": 6.1, "cached_input": 0.17}},
)


def rules(spark: SparkSession) -> DataFrame:
    from datetime import datetime

    from ..operators.pricing import rules_from

    common = {"currency": "USD", "price_unit": "1M tokens", "source_url": "https://rates.example.com/list", "checked_at": datetime(2024, 1, 31)}
    when = lambda r: {k: datetime.fromisoformat(r[k] + "+00:00") if k in r else None for k in ("effective_from", "effective_to")}
    return rules_from(spark, [r | common | when(r) for r in RULES])


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint") * 1000
    provider = F.get(F.array(*map(F.lit, PROVIDERS)), (i % 4).cast("int"))
    model = F.when(i % 17 != 0, F.get(F.array(*map(F.lit, MODELS)), ((F.col("user_id") + i % 3) % 6).cast("int")))
    codexlike = (i % 4).isin(1, 3)
    started = F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp"))
    cost = F.when(F.col("event_type") == "purchase", F.struct((F.col("value").cast("decimal(18,2)") * F.lit(0.01).cast("decimal(3,2)")).alias("amount"), F.when(i % 1000 == 0, "EUR").otherwise("USD").alias("currency")))
    rows = e.select(
        provider.alias("provider"), model.alias("model"), model.alias("own_model"),
        F.when(i % 23 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"),
        F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string")).alias("source_path"),
        started.alias("started_at"), started.alias("observed_at"),
        tokens_struct(input=F.floor(F.col("value") * 1000), output=F.floor(F.col("value") * 100), cached_input=F.when(codexlike, k), cache_read=F.when(~codexlike, k)).alias("tokens"),
        cost.alias("imported_cost"), (i % 101 == 0).alias("pricing_unavailable"), i.alias("seq"),
    )
    return as_records(rows)


def usage_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each order line, for measuring."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
    i = F.col("l_orderkey") + F.col("l_linenumber")
    started = F.date_trunc("MILLISECOND", F.col("o_orderdate").cast("timestamp")) + F.make_dt_interval(mins=i % 1440)
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.get(F.array(*map(F.lit, PROVIDERS)), (i % 4).cast("int")).alias("provider"),
        F.get(F.array(*map(F.lit, MODELS)), (F.col("l_partkey") % 6).cast("int")).alias("model"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"), F.lit("f").alias("source_path"),
        started.alias("started_at"), started.alias("observed_at"),
        tokens_struct(input=F.floor("l_extendedprice"), output=F.floor("l_quantity"), cached_input=F.col("l_partkey")).alias("tokens"),
    )
    return as_records(rows)
