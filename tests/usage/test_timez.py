from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from meterloom.functions import timez as T

UTC = timezone.utc


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def span(kind, now, zone, *bounds):
    r = T.resolve_range(kind, at(now), zone, *bounds)
    return r.start, r.end


def test_weeks_begin_on_monday_in_the_zone():
    now = "2026-05-10T02:00"
    assert span("thisWeek", now, "Asia/Taipei") == (at("2026-05-03T16:00"), at("2026-05-10T15:59:59.999"))
    assert span("lastWeek", now, "Asia/Taipei") == (at("2026-04-26T16:00"), at("2026-05-03T15:59:59.999"))
    assert span("lastMonth", now, "Asia/Taipei") == (at("2026-03-31T16:00"), at("2026-04-30T15:59:59.999"))
    assert span("nonsense", now, "Asia/Taipei") == span("thisWeek", now, "Asia/Taipei")
    assert span("yesterday", now, "UTC") == (at("2026-05-09"), at("2026-05-09T23:59:59.999"))
    assert span("thisMonth", now, "UTC") == (at("2026-05-01"), at("2026-05-31T23:59:59.999"))


def test_custom_bounds():
    assert span("custom", "2026-08-09T00:00", "Asia/Shanghai", "2026-08-07T18", "2026-08-08T18") == (at("2026-08-07T10:00"), at("2026-08-08T10:59:59.999"))
    today = span("today", "2026-08-09T00:00", "UTC")
    assert span("custom", "2026-08-09T00:00", "UTC", "2020-02-30T12", "2020-03-01") == today
    assert span("custom", "2026-08-09T00:00", "UTC", None, None) == today
    assert T.valid_custom("2026-01-01T9:00", "2026-01-01T10") and not T.valid_custom("1999-01-01", "2026-01-01")
    assert not T.valid_custom("2026-01-02", "2026-01-01") and not T.valid_custom("2026-01-01T25", "2026-01-02")


@pytest.mark.parametrize("wall, zone, want", [("2026-03-08T02:30", "America/New_York", "2026-03-08T06:30"), ("2026-10-25T02:30", "Europe/Berlin", "2026-10-25T01:30"), ("2026-03-29T00:00", "Asia/Beirut", "2026-03-28T22:00")])
def test_gaps_and_overlaps_of_the_clock(spark, wall, zone, want):
    assert T.local_to_utc(datetime.fromisoformat(wall), zone) == at(want)
    row = spark.range(1).select(T.local_to_utc_col(F.to_timestamp(F.lit(wall.replace("T", " "))), zone).cast("long").alias("s")).first()
    assert row.s == int(at(want).timestamp())


def test_repeated_hour_has_two_buckets(spark):
    rows = spark.createDataFrame([("2026-11-01 05:30:00",), ("2026-11-01 06:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    got = rows.select(T.hour_bucket(F.col("t"), "America/New_York").alias("b"), T.bucket_start(F.col("t"), "America/New_York", "hour").cast("long").alias("s")).collect()
    assert [r.b for r in got] == ["2026-11-01T01-04:00", "2026-11-01T01-05:00"]
    assert [r.s for r in got] == [int(at("2026-11-01T05:00").timestamp()), int(at("2026-11-01T06:00").timestamp())]


def test_zones_and_labels():
    assert T.resolve_zone("custom", "Mars/Base", "Asia/Tokyo") == "Asia/Tokyo" and T.resolve_zone("utc") == "UTC"
    assert T.resolve_zone("custom", "Asia/Taipei") == "Asia/Taipei" and T.offset_label(at("2026-01-01"), "Asia/Kolkata") == "+05:30"
    assert T.add_days("2026-02-28", 1) == "2026-03-01"
    assert T.resolve_range("custom", at("2026-01-01"), "UTC", "2026-01-01", "2026-01-02").granularity == "hour"
    assert T.resolve_range("thisWeek", at("2026-01-01"), "UTC").granularity == "day"


def test_durations(spark):
    minutes = spark.createDataFrame([(0,), (59,), (60,), (1441,), (1500,), (None,)], "m bigint")
    assert [r.x for r in minutes.select(T.duration_text(F.col("m")).alias("x")).collect()] == ["<1m", "59m", "1h", "1d", "1d 1h", None]
