"""All rollups of one range, from one pass over its records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.timez import TimeRange
from ..operators import filters, pricing, quality, rollup


@dataclass
class Summary:
    """Lazy frames over two persisted ones, by session and bucket and by session; call close() when done. priced is not persisted, and None where rollups are made of stored partials."""

    priced: DataFrame | None
    by_bucket: DataFrame
    by_session: DataFrame
    totals: DataFrame
    provider_split: DataFrame
    model_split: DataFrame
    trend: DataFrame
    sessions: DataFrame
    issues: DataFrame | None

    def close(self) -> None:
        self.by_session.unpersist()
        self.by_bucket.unpersist()


def summarise(records: DataFrame, span: TimeRange, rules: DataFrame, provider: str = "all", issues: DataFrame | list[DataFrame] | None = None) -> Summary:
    """Filters first, prices once, adds up once by session and bucket, and makes five rollups of that.

    issues can be those of several steps.
    """
    kept = filters.for_provider(filters.in_range(records, span), provider)
    priced = pricing.price(kept, pricing.rate_book(rules), pricing.catalog_is_valid(rules))
    found = issues if issues is None or isinstance(issues, DataFrame) else quality.all_issues(*issues)
    return rollups_of(rollup.partial_rollup(priced, *rollup.buckets(span)), priced, None if found is None else filters.issues_for_provider(found, provider))


def rollups_of(partials: DataFrame, priced: DataFrame | None = None, issues: DataFrame | None = None) -> Summary:
    """Five rollups from partial_rollup() rows by session and bucket, computed now or stored by a stream.

    Rows of by_session are sessions, so no rollup counts distinct ones.
    """
    by_bucket = partials.persist(StorageLevel.MEMORY_AND_DISK)
    by_session = rollup.by_session(by_bucket).persist(StorageLevel.MEMORY_AND_DISK)
    return Summary(priced, by_bucket, by_session, rollup.totals_of(by_session), rollup.provider_split_of(by_session), rollup.model_split_of(by_session), rollup.trend_of(by_bucket), rollup.sessions_of(by_session), issues)
