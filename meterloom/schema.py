"""The record schema and the names that all modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVIDERS = ("claude", "codex", "pi", "grok")
#: Token categories, null where a log does not name them, which is not the same as 0.
TOKENS = ("input", "output", "cached_input", "cache_read", "cache_write_5m", "cache_write_1h")

TOKENS_TYPE = f"struct<{', '.join(f'{t}: bigint' for t in TOKENS)}>"
#: Ten digits before the point: rates stand in any currency, and a decimal of 18 digits is a long inside.
RATE_TYPE = "decimal(18,8)"
RATES_TYPE = f"struct<{', '.join(f'{t}: {RATE_TYPE}' for t in TOKENS)}>"
COST_TYPE = "struct<amount: decimal(38,10), currency: string, source: string, source_url: string, checked_at: timestamp, note: string>"
RECORD_TYPES = {
    "provider": "string",
    "model": "string",
    "session_id": "string",
    "started_at": "timestamp",
    "ended_at": "timestamp",
    "observed_at": "timestamp",
    "tokens": TOKENS_TYPE,
    "imported_cost": "struct<amount: decimal(38,10), currency: string>",
    "pricing_unavailable": "boolean",
    "source_path": "string",
    "source_kind": "string",
    "root_id": "string",
    "seq": "bigint",
    "line_no": "bigint",
    "own_model": "string",
}
RECORD_SCHEMA = ", ".join(f"{k} {t}" for k, t in RECORD_TYPES.items())
ISSUE_SCHEMA = "severity string, code string, message string, source_path string, line_no bigint, provider string, n bigint"


def as_records(df: DataFrame) -> DataFrame:
    """df in the record schema: missing columns are null, and event_ts and utc_date are derived."""
    have = set(df.columns)
    columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in RECORD_TYPES.items()]
    ts = F.coalesce("started_at", "observed_at")
    return df.select(*columns).withColumns({"event_ts": ts, "utc_date": F.to_date(ts)})


def as_issues(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in (x.split() for x in ISSUE_SCHEMA.split(", "))])


def tokens_struct(**columns: Column | None) -> Column:
    """The tokens struct from columns by category; those not given are null."""
    return F.struct(*[(columns[t] if columns.get(t) is not None else F.lit(None)).cast("bigint").alias(t) for t in TOKENS])
