"""Range and provider filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timez import TimeRange, literal


def in_range(df: DataFrame, span: TimeRange) -> DataFrame:
    """Records inside a range, both ends included."""
    return df.where(F.col("event_ts").between(literal(span.start), literal(span.end)))


def for_provider(df: DataFrame, provider: str = "all") -> DataFrame:
    return df if provider == "all" else df.where(F.col("provider") == provider)


def issues_for_provider(issues: DataFrame, provider: str = "all") -> DataFrame:
    """Like for_provider(), but issues without a provider always stay."""
    return issues if provider == "all" else issues.where((F.col("provider") == provider) | F.col("provider").isNull())


def spans_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)
