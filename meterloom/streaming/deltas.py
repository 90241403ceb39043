"""Counter logs as a stream of lines, and what is kept up to date from it.

The stream brings lines with source_path and line_no, from immutable segments or
a message topic. Each batch is an ordinary job: what is known of a file's earlier
lines stands in a table of states and goes before its new lines as one row, so the
expressions that read whole logs read a batch too. The same table says on which
days a file has rows, so a batch reads and writes those days alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timez import TimeRange, day_bucket
from ..operators import ingest, pricing, rollup
from ..operators.ingest import COUNTERS
from ..schema import TOKENS, as_records
from ..sources import store
from .states import read_states, tidy_states, write_states

_TOTALS = f"struct<{', '.join(f'{c}: bigint' for c in COUNTERS)}>"
#: What is known of a file: its last telling line, totals, model and session, all its models, the number of its records, and the days of those and of the ones that name no model.
STATE_SCHEMA = f"source_path string, line_no bigint, totals {_TOTALS}, model string, session string, models array<string>, seq bigint, days array<date>, unnamed_days array<date>"
REFRESH_SECONDS = (30, 86400)
Days = set[tuple]


def trigger_seconds(asked: int) -> int:
    """A refresh interval inside what is allowed."""
    return min(max(asked, REFRESH_SECONDS[0]), REFRESH_SECONDS[1])


def interval_seconds(asked: F.Column) -> F.Column:
    """trigger_seconds() of a column, for settings in a table."""
    low, high = REFRESH_SECONDS
    return F.least(F.greatest(asked, F.lit(low)), F.lit(high)).cast("bigint")


def only_model(models: F.Column) -> F.Column:
    """The model of a file that names one alone."""
    return F.when(F.size(models) == 1, F.get(models, F.lit(0)))


def batch_rows(lines: DataFrame) -> DataFrame:
    """Lines of counter logs, parsed and reduced to what records and states are made of."""
    parsed, _ = ingest.parse_rows(ingest.skip_bulk(ingest.telling(lines)), recover=True, places=ingest.COUNTER_PLACES)
    return ingest.counter_rows(parsed)


def batch_records(rows: DataFrame, states: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Records (source_path, line_no, seq, own_model, session_id, times, tokens) of new batch_rows(), and the states of their files after them.

    Lines up to a file's last one have been seen and say nothing. states may hold
    other files' rows too. cut gets the records before they are numbered and the
    numbered ones; a caller may write them there, since each is read several times.
    """
    known = states.join(rows.select("source_path").distinct(), "source_path", "left_semi")
    fresh = rows.join(known.select("source_path", F.col("line_no").alias("_seen")), "source_path", "left").where(F.col("_seen").isNull() | (F.col("line_no") > F.col("_seen"))).drop("_seen")
    carried = {"_totals": F.col("totals"), "_model": F.col("model"), "_context": F.col("session"), "_session": F.col("session"), "_empty": F.lit(False)}
    before = known.select("source_path", "line_no", *[carried.get(c, F.lit(None)).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns[2:]])
    whole = fresh.withColumn("_new", F.lit(True)).unionByName(before.withColumn("_new", F.lit(False)))
    used = ingest.counter_usage(ingest.fill_from_file(whole, ingest.TOTALS_BEFORE))
    kept = used.where(F.col("_new") & F.col("tokens").isNotNull() & ingest.has_usage(F.col("tokens"), F.lit(None)))
    kept = kept.withColumn("observed_at", F.coalesce("observed_at", F.current_timestamp()))
    kept = ingest.numbered(cut(kept.select("source_path", "line_no", "own_model", "session_id", "started_at", "observed_at", "tokens")))
    records = kept.join(known.select("source_path", F.col("seq").alias("_had")), "source_path", "left").withColumn("seq", F.col("seq") + F.coalesce("_had", F.lit(0)))
    records = cut(records.select("source_path", "line_no", "seq", "own_model", "session_id", "started_at", "observed_at", "tokens"))

    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    seen = whole.groupBy("source_path").agg(F.max("line_no").alias("line_no"), last("_totals").alias("totals"), last("_model").alias("model"), last("_context").alias("session"), F.collect_set("_model").alias("_models"))
    day = F.to_date(F.coalesce("started_at", "observed_at"))
    made = records.groupBy("source_path").agg(F.count("*").alias("_n"), F.collect_set(day).alias("_days"), F.collect_set(F.when(F.col("own_model").isNull(), day)).alias("_unnamed"))
    old = known.select("source_path", F.col("models").alias("_m"), F.col("seq").alias("_s"), F.col("days").alias("_d"), F.col("unnamed_days").alias("_u"))
    joined = seen.join(made, "source_path", "left").join(old, "source_path", "left")
    both = lambda a, b, kind: F.array_sort(F.array_union(F.coalesce(a, F.array().cast(kind)), F.coalesce(b, F.array().cast(kind))))
    columns = {"models": both("_models", "_m", "array<string>"), "seq": F.coalesce("_n", F.lit(0)) + F.coalesce("_s", F.lit(0)), "days": both("_days", "_d", "array<date>"), "unnamed_days": both("_unnamed", "_u", "array<date>")}
    return records, joined.withColumns(columns).select(*[x.split(" ", 1)[0] for x in _fields(STATE_SCHEMA)])


def _fields(schema: str) -> list[str]:
    """The columns of a schema text, whose types may hold commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def upsert(path: str, provider: str, root: str, after: Callable[[Days], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for lines: stores a batch's records below path, in records, and the states of its files, in states.

    Earlier rows without a model of their own get one, or lose it, where their
    file's only model has changed; no other earlier row changes, and no day is
    read but those of such rows and of the batch's records. Rows are replaced by
    file and ordinal, and states belong to batches, so a batch that is run again
    changes nothing. after gets the touched partitions, (provider, utc_date) each.
    """
    table, states_path = f"{path}/records", f"{path}/states"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        store.recover(spark, table)
        tidy_states(spark, states_path, number)
        states = read_states(spark, states_path, STATE_SCHEMA, before=number)
        # Written, so that lines are parsed once, windows run once, and a lost machine costs no more than its part.
        scratch, steps = f"{path}/batch-{number}", itertools.count()

        def cut(df: DataFrame) -> DataFrame:
            at = f"{scratch}/step-{next(steps)}"
            df.write.mode("overwrite").parquet(at)
            return spark.read.schema(df.schema).parquet(at)

        records, now = batch_records(cut(batch_rows(batch)), states, cut)
        write_states(now, states_path, STATE_SCHEMA, number)
        now = read_states(spark, states_path, STATE_SCHEMA, only=number)
        file_id = store.hashed_id(F.lit(provider), F.lit(root), F.col("source_path"))
        models = now.select("source_path", only_model(F.col("models")).alias("_only"))
        before = states.select("source_path", only_model(F.col("models")).alias("_was"), "unnamed_days")
        changed = before.join(models, "source_path").where((F.size("unnamed_days") > 0) & ~F.col("_was").eqNullSafe(F.col("_only")))
        new = as_records(records.join(models, "source_path", "left").withColumns({"provider": F.lit(provider), "model": F.coalesce("own_model", "_only"), "session_id": F.coalesce("session_id", ingest.base_name(F.col("source_path")))}))
        new = store.pseudonymise(new, root)
        renamed = changed.select(F.lit(provider).alias("provider"), F.explode("unnamed_days").alias("utc_date"))
        days = store.days_of(new, renamed)
        if days:
            told = changed.select(file_id.alias("file_id"), "_only", F.lit(True).alias("_changed"))
            old = store.read_records(spark, table).where(store.in_days(days)).join(new.select("file_id", "seq"), ["file_id", "seq"], "left_anti").join(told, "file_id", "left")
            model = F.when(F.col("_changed") & F.col("own_model").isNull(), F.col("_only")).otherwise(F.col("model"))
            store.overwrite_days(spark, old.withColumn("model", model).drop("_only", "_changed").unionByName(new.select(*store.COLUMNS), allowMissingColumns=True), days, table)
        fs, used = store.file_system(spark, scratch)
        fs.delete(used, True)
        if after and days:
            after(days)

    return run


def daily_rollup(spark: SparkSession, records_path: str, path: str) -> Callable[[Days], None]:
    """An after function for upsert(): keeps records and tokens by provider, day and model, and adds up only the days that a batch has touched.

    Days are partitions of the table under path and are overwritten whole, so a
    batch that is run again changes nothing, and late rows touch an older day.
    """

    def run(days: Days) -> None:
        rows = store.read_records(spark, records_path).where(store.in_days(days))
        sums = [F.sum(f"tokens.{t}").alias(t) for t in TOKENS]
        added = rows.groupBy("provider", "utc_date", "model").agg(F.count("*").alias("records"), *sums).select("model", "records", *TOKENS, "provider", "utc_date")
        _over(added, path)

    return run


def _over(rows: DataFrame, path: str) -> None:
    keys = ["provider", "utc_date"]
    rows.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def session_partials(spark: SparkSession, records_path: str, path: str, rules: DataFrame, zone: str) -> Callable[[Days], None]:
    """An after function for upsert(): keeps partial_rollup() rows by session and local hour, priced, for the days that a batch has touched.

    What all rollups of any range are added up from, with costs, sessions and
    trend; partials_in() and summary.rollups_of() read it.
    """
    index, valid = pricing.rate_index(pricing.rate_book(rules)), pricing.catalog_is_valid(rules)

    def run(days: Days) -> None:
        priced = pricing.price(store.read_records(spark, records_path).where(store.in_days(days)), index, valid)
        _over(rollup.partial_rollup(priced, F.col("utc_date"), *rollup.buckets_of("hour", zone)), path)

    return run


def partials_in(partials: DataFrame, span: TimeRange) -> DataFrame:
    """Rows as of partial_rollup() over the records of a range, from stored partials by local hour of the same zone.

    The range must begin and end with an hour, as those of local days do.
    """
    rows = partials.where(F.col("bucket_start").between(F.lit(span.start), F.lit(span.end))).where(F.col("utc_date").between(F.lit(span.start.date()), F.lit(span.end.date())))
    if span.granularity == "day":
        start = rollup.buckets_of("day", span.zone, F.col("bucket_start"))
        rows = rows.withColumns({"bucket": day_bucket(F.col("bucket_start"), span.zone), "bucket_start": start[1]})
    times = [F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("_model").alias("_model")]
    return rows.groupBy("provider", "_session", "_name", "bucket", "bucket_start").agg(*rollup.added_up(sessions=False), *times)
