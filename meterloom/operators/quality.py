"""Coverage, stale sources, load status and pattern scans."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timez import literal
from ..schema import as_issues

#: What a text for sharing should not hold, with a reason each; any other list can be given. No look-around, so that other engines read them too.
DENY_PATTERNS = (
    (r"(?:/home/|/Users/|\b[A-Za-z]:\\Users\\)[\w.-]+[/\\]", "personal folder"),
    (r"\b[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\b", "UUID"),
    (r"\b(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20})", "issued key"),
    (r"(?i)\bauthorization\s*:\s*[a-z]+\s+\S{12,}", "authorization header"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key"),
)
#: Codes after which a source can't be called empty. Fixed values.
UNDETERMINED = ("file_transient", "wal_unsupported", "file_unreadable", "unsupported_schema", "invalid_timestamp", "source_file_limit")


def scan_patterns(df: DataFrame, text_col: str, key_cols: Sequence[str], patterns: Sequence[tuple[str, str]] = DENY_PATTERNS, allow: DataFrame | None = None) -> DataFrame:
    """One row for each key and reason whose pattern occurs in the text; allow has the keys and reasons that are let through."""
    tests = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(p), F.lit(reason)) for p, reason in patterns]))
    found = df.select(*key_cols, F.explode(tests).alias("reason"))
    return found if allow is None else found.join(allow, [*key_cols, "reason"], "left_anti")


def all_issues(*steps: DataFrame) -> DataFrame:
    """The issues of all steps of an ingestion in one table."""
    out = as_issues(steps[0])
    for more in steps[1:]:
        out = out.unionByName(as_issues(more))
    return out


def coverage(actions: DataFrame, manifest: DataFrame) -> DataFrame:
    """provider, source_path, files, records and complete of each source; actions has these two, path and action."""
    counts = manifest.select("path", "records")
    joined = actions.join(counts, "path", "left")
    skipped = F.count_if((F.col("action") == "skip") & F.col("records").isNull())
    return joined.groupBy("provider", "source_path").agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), (skipped == 0).alias("complete"))


def stale_sources(cover: DataFrame, issues: DataFrame, detected: DataFrame) -> DataFrame:
    """Issues for configured sources that were read whole and hold nothing while another root of the provider holds files."""
    doubt = issues.where((F.col("severity") == "error") | F.col("code").isin(*UNDETERMINED)).select("provider").distinct()
    empty = cover.where("complete AND records = 0").join(doubt, "provider", "left_anti")
    other = detected.select("provider", F.col("source_path").alias("_other"))
    found = empty.join(other, "provider").where("source_path <> _other")
    return as_issues(found.select(F.lit("warning").alias("severity"), F.lit("source_alternative_detected").alias("code"), F.concat(F.lit("files were found in "), F.col("_other")).alias("message"), "source_path", "provider"))


def failed_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Files that are listed with bytes but gave no line: their rows and entries stay as they were."""
    read = lines.select(F.col("source_path").alias("path")).distinct()
    return files.where("size > 0").join(read, "path", "left_anti")


def settled(files: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Files that have not been written to for a while."""
    return files.where(F.col("modified_at") <= literal(now - timedelta(seconds=seconds)))


def load_status(actions: DataFrame, force: bool = False) -> DataFrame:
    """One row: status (cold, rebuilding, warm or partial) and history_complete."""
    read, skipped = F.count_if(F.col("action") == "ingest"), F.count_if((F.col("action") == "skip") & F.col("skip_reason").isNotNull())
    status = F.when(read > 0, F.lit("rebuilding" if force else "cold")).when(skipped == 0, "warm").otherwise("partial")
    return actions.agg(status.alias("status"), (skipped == 0).alias("history_complete"))


def check_paths(sources: DataFrame, platform: str) -> DataFrame:
    """Issues for configured paths (provider, path) that are not of the platform's form; blank ones are not configured."""
    path = F.trim("path")
    foreign = path.startswith("/") if platform == "win32" else path.rlike(r"^[a-zA-Z]:[\\/]") | path.startswith("\\\\")
    bad = sources.where((path != "") & foreign)
    return as_issues(bad.select(F.lit("warning").alias("severity"), F.lit("non_native_path").alias("code"), F.concat("provider", F.lit(f" usage path does not look valid on {platform}")).alias("message"), path.alias("source_path"), "provider"))
