"""Operators on DataFrames: ingestion, pricing, rollups, currency and quality."""
