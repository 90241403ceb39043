"""Numbers derived from tokens and costs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOKENS


def token_total(tokens: Column) -> Column:
    return sum((F.coalesce(tokens[t], F.lit(0)) for t in TOKENS[1:]), F.coalesce(tokens[TOKENS[0]], F.lit(0)))


def row_total() -> Column:
    """Like token_total(), over plain columns of an aggregated frame."""
    return sum((F.coalesce(F.col(t), F.lit(0)) for t in TOKENS[1:]), F.coalesce(F.col(TOKENS[0]), F.lit(0)))


def cache_create() -> Column:
    return F.coalesce(F.col("cache_write_5m"), F.lit(0)) + F.coalesce(F.col("cache_write_1h"), F.lit(0))


def cache_read_all() -> Column:
    return F.coalesce(F.col("cache_read"), F.lit(0)) + F.coalesce(F.col("cached_input"), F.lit(0))


def derived_metrics(df: DataFrame) -> DataFrame:
    """Cache rate and ratio, cost and tokens for each record, on an aggregated frame."""
    read, total = cache_read_all(), row_total()
    sent = F.coalesce(F.col("input"), F.lit(0)) + read
    return df.withColumns(
        {
            "token_total": total,
            "cache_create": cache_create(),
            "cache_read_all": read,
            "cache_rate": F.when(sent > 0, read / sent),
            "cache_ratio": F.when(total > 0, read / total).otherwise(F.lit(0.0)),
            "cost_per_record": F.when(F.col("records") > 0, F.col("cost_amount").cast("double") / F.col("records")),
            "tokens_per_record": F.when(F.col("records") > 0, total / F.col("records")),
        }
    )


def provider_share(split: DataFrame) -> DataFrame:
    """Each provider's share of all records; the whole counts as one record at least."""
    # A split has one row for each provider.
    whole = F.greatest(F.sum("records").over(Window.partitionBy(F.lit(0))), F.lit(1))
    return split.withColumn("share", F.col("records") / whole)


def trend_series(trend: DataFrame) -> DataFrame:
    """The trend as bucket, metric and value: cost (0 where missing), records, input, output, cache_create and cache_read."""
    wide = trend.select(
        "bucket",
        F.coalesce(F.col("cost_amount").cast("double"), F.lit(0.0)).alias("cost"),
        F.col("records").cast("double").alias("records"),
        F.coalesce("input", F.lit(0)).cast("double").alias("input"),
        F.coalesce("output", F.lit(0)).cast("double").alias("output"),
        cache_create().cast("double").alias("cache_create"),
        cache_read_all().cast("double").alias("cache_read"),
    )
    return wide.unpivot("bucket", [c for c in wide.columns if c != "bucket"], "metric", "value")
