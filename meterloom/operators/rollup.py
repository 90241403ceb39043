"""Rollups of priced records.

Records are added up by session first, with one set of aggregates that can be
added up again; every rollup is made of those rows, so none counts distinct
sessions, and each kind of sum is stated once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timez import TimeRange, bucket_start, day_bucket, hour_bucket
from ..schema import PROVIDERS, TOKENS

UNKNOWN = "unknown"


def session_key() -> Column:
    """A session is told by provider, session id (else the log's path) and model: two models make two sessions.

    Without nulls, since a distinct count leaves out structs with a null.
    """
    return F.struct(F.col("provider"), F.coalesce("session_id", "source_path", F.lit("")).alias("session"), F.coalesce("model", F.lit(UNKNOWN)).alias("model"))


def usage_aggs() -> list[Column]:
    """The aggregates that every rollup shares; finish_costs() turns the last seven into the cost's columns."""
    return [
        F.count("*").alias("records"),
        *[F.sum(f"tokens.{t}").alias(t) for t in TOKENS],
        F.count("cost.amount").alias("_costs"),
        F.min("cost.currency").alias("_c0"),
        F.max("cost.currency").alias("_c1"),
        F.sum("cost.amount").alias("_sum"),
        F.min("cost.source").alias("_source"),
        F.struct(F.min("cost.source_url").alias("a"), F.max("cost.source_url").alias("b"), F.count("cost.source_url").alias("n")).alias("_url"),
        F.max("cost.checked_at").alias("_checked"),
    ]


def partial_rollup(records: DataFrame, *keys: Column) -> DataFrame:
    """One row for each session and keys, with aggregates that can be added up: what all rollups of a summary are made from.

    _model is the model as recorded, null where it is missing.
    """
    key = session_key()
    rows = records.select("*", key["session"].alias("_session"), key["model"].alias("_name"), *keys)
    by = ["provider", "_session", "_name", *rows.columns[len(records.columns) + 2 :]]
    times = [F.min("started_at").alias("started_at"), F.max(F.coalesce("ended_at", "observed_at")).alias("ended_at"), F.max("model").alias("_model")]
    return rows.groupBy(*by).agg(*usage_aggs(), *times)


def by_session(partials: DataFrame) -> DataFrame:
    """Rows of partial_rollup() of several keys, one a session."""
    times = [F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("_model").alias("_model")]
    return partials.groupBy("provider", "_session", "_name").agg(*added_up(sessions=False), *times)


def added_up(sessions: bool = True) -> list[Column]:
    """usage_aggs() over rows of partial_rollup(): each row there is a session of its own if keys are grouped or not there."""
    return [
        F.sum("records").alias("records"),
        *([F.count("*").alias("sessions")] if sessions else []),
        *[F.sum(t).alias(t) for t in TOKENS],
        F.sum("_costs").alias("_costs"),
        F.min("_c0").alias("_c0"),
        F.max("_c1").alias("_c1"),
        F.sum("_sum").alias("_sum"),
        F.min("_source").alias("_source"),
        F.struct(F.min("_url.a").alias("a"), F.max("_url.b").alias("b"), F.sum("_url.n").alias("n")).alias("_url"),
        F.max("_checked").alias("_checked"),
    ]


def finish_costs(df: DataFrame) -> DataFrame:
    """One cost from the aggregates, none where costs are in several currencies.

    A sum of several is rounded to six decimals, one alone is not. The source is
    `calculated` if any part is. The URL stays if all parts have the same. The
    note is `partial` where records have no cost.
    """
    one = (F.col("_costs") > 0) & (F.col("_c0") == F.col("_c1"))
    url = F.when((F.col("_url.a") == F.col("_url.b")) & (F.col("_url.n") == F.col("_costs")), F.col("_url.a"))
    amount = F.when(F.col("_costs") > 1, F.round("_sum", 6)).otherwise(F.col("_sum"))
    columns = {"cost_amount": amount, "cost_currency": F.col("_c0"), "cost_source": F.col("_source"), "cost_url": url, "cost_checked_at": F.col("_checked"), "cost_note": F.when(F.col("_costs") < F.col("records"), F.lit("partial"))}
    return df.withColumns({k: F.when(one, v) for k, v in columns.items()}).drop("_costs", "_c0", "_c1", "_sum", "_source", "_url", "_checked")


def _named(model: Column) -> Column:
    return F.when(F.trim(model) != "", model)


def totals(records: DataFrame) -> DataFrame:
    """One row, of zeros and nulls for no record."""
    return totals_of(partial_rollup(records))


def totals_of(found: DataFrame) -> DataFrame:
    """totals() from rows by session."""
    active = F.count_distinct(_named(F.col("_model"))).alias("active_models")
    return finish_costs(found.agg(*added_up(), active).withColumn("records", F.coalesce("records", F.lit(0))))


def all_providers(found: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """A split by provider with a row for each of the providers, in their order, zeros where there was none."""
    listed = found.sparkSession.createDataFrame([(p, i) for i, p in enumerate(providers)], "provider string, _n int")
    out = listed.join(found, "provider", "left").orderBy("_n").drop("_n")
    return out.withColumns({"records": F.coalesce("records", F.lit(0)), "sessions": F.coalesce("sessions", F.lit(0))})


def provider_split(records: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """All providers in their order, those without records with zeros."""
    return provider_split_of(partial_rollup(records), providers)


def provider_split_of(found: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """provider_split() from rows by session."""
    return all_providers(finish_costs(found.groupBy("provider").agg(*added_up())), providers)


def model_split(records: DataFrame) -> DataFrame:
    """By provider and model, most records first, then by name."""
    return model_split_of(partial_rollup(records))


def model_split_of(found: DataFrame) -> DataFrame:
    """model_split() from rows by session."""
    named = found.withColumn("model", F.col("_name"))
    return finish_costs(named.groupBy("provider", "model").agg(*added_up())).orderBy(F.desc("records"), "provider", "model")


def buckets_of(kind: str, zone: str, ts: Column | None = None) -> list[Column]:
    """bucket and bucket_start of ts, else of event_ts: local hours or days."""
    ts = F.col("event_ts") if ts is None else ts
    label = hour_bucket(ts, zone) if kind == "hour" else day_bucket(ts, zone)
    return [label.alias("bucket"), bucket_start(ts, zone, kind).alias("bucket_start")]


def buckets(span: TimeRange, granularity: str | None = None) -> list[Column]:
    """bucket and bucket_start of event_ts in a range."""
    return buckets_of(granularity or span.granularity, span.zone)


def trend(records: DataFrame, span: TimeRange, granularity: str | None = None) -> DataFrame:
    """By local hour or day, buckets with records only, in order of time."""
    return trend_of(partial_rollup(records, *buckets(span, granularity)))


def trend_of(found: DataFrame) -> DataFrame:
    """trend() from rows by session and bucket."""
    return finish_costs(found.groupBy("bucket", "bucket_start").agg(*added_up())).orderBy("bucket_start")


def sessions(records: DataFrame) -> DataFrame:
    """By session, newest first, those without a start last."""
    return sessions_of(partial_rollup(records))


def sessions_of(found: DataFrame) -> DataFrame:
    """sessions() from rows by session."""
    named = found.drop("_model").withColumnsRenamed({"_session": "session", "_name": "model"})
    return finish_costs(named).orderBy(F.desc_nulls_last("started_at"), "provider", "session", "model")


def cost_by_currency(split: DataFrame) -> DataFrame:
    """Costs of a split by currency, for totals that mix them."""
    return split.where("cost_amount IS NOT NULL").groupBy(F.col("cost_currency").alias("currency")).agg(F.sum("cost_amount").alias("cost_amount"), F.count("*").alias("parts"))


def top_models(split: DataFrame, n: int = 12) -> DataFrame:
    return split.orderBy(F.desc("records"), "provider", "model").limit(n)


def top_sessions(rollup: DataFrame, n: int = 60) -> DataFrame:
    """The n newest sessions of each provider."""
    by = Window.partitionBy("provider").orderBy(F.desc_nulls_last("started_at"), "session", "model")
    return rollup.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n").orderBy(F.desc_nulls_last("started_at"), "provider", "session", "model")


def top_issues(issues: DataFrame, n: int = 20) -> DataFrame:
    """Errors before warnings."""
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    return issues.orderBy(rank, "code", "source_path", "line_no", "message").limit(n)


def active_models(records: DataFrame) -> DataFrame:
    return records.where(F.trim("model") != "").select("model").distinct()


def currency_codes(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """All codes of frames with a column code, each once, in order."""
    out = frames[0].select("code")
    for f in frames[1:]:
        out = out.union(f.select("code"))
    return out.where("code IS NOT NULL").distinct().orderBy("code")
