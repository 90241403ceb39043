"""Calendar ranges in a zone, resolved on the driver, and time buckets as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_KINDS = ("today", "yesterday", "thisWeek", "lastWeek", "thisMonth", "lastMonth", "custom")
DEFAULT_KIND = "thisWeek"
EARLIEST = date(2000, 1, 1)
_HOUR_SPAN = timedelta(hours=48)
_MS = timedelta(milliseconds=1)


@dataclass(frozen=True)
class TimeRange:
    """Both ends are inside; end is the last millisecond."""

    kind: str
    zone: str
    start: datetime
    end: datetime

    @property
    def granularity(self) -> str:
        """hour for spans of at most 48 hours, else day."""
        return "hour" if self.end - self.start <= _HOUR_SPAN else "day"


def resolve_zone(mode: str, custom: str | None = None, system: str = "UTC") -> str:
    """The zone of a mode (system, utc or custom); an unknown custom zone falls back to the system's."""
    if mode.lower() == "utc":
        return "UTC"
    if mode.lower() == "custom" and custom in available_timezones():
        return custom
    return system


def offset_label(at: datetime, zone: str) -> str:
    """The zone's offset at an instant, as +08:00."""
    minutes = int(_offset(at, zone).total_seconds()) // 60
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def _offset(at: datetime, zone: str) -> timedelta:
    return at.astimezone(ZoneInfo(zone)).utcoffset()


def local_to_utc(wall: datetime, zone: str) -> datetime:
    """The instant of a wall time: the offset is looked up at a first guess, then at the guess it gives."""
    guess = wall.replace(tzinfo=timezone.utc)
    first = guess - _offset(guess, zone)
    return guess - _offset(first, zone)


def local_to_utc_col(wall: Column, zone: str) -> Column:
    """local_to_utc() for a timestamp column that holds wall times under a UTC session zone."""

    def offset(t: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)

    base = F.unix_micros(wall)
    first = F.timestamp_micros(base - offset(wall))
    return F.timestamp_micros(base - offset(first))


def parse_bound(text: str | None) -> tuple[date, int | None] | None:
    """A day, or a day and an hour (one or two digits, minutes 00 or none); None for anything else or impossible dates."""
    found = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})(?:T(\d{1,2})(?::00)?)?", text or "")
    if not found:
        return None
    try:
        day = date(*map(int, found.groups()[:3]))
    except ValueError:
        return None
    hour = None if found[4] is None else int(found[4])
    return None if hour is not None and hour > 23 else (day, hour)


def valid_custom(start: str | None, end: str | None) -> bool:
    """Whether two bounds may be asked for: both parse, from 2000 on, and in order."""
    a, b = parse_bound(start), parse_bound(end)
    return bool(a and b) and a[0] >= EARLIEST and (a[0], a[1] or 0) <= (b[0], 23 if b[1] is None else b[1])


def resolve_range(kind: str, now: datetime, zone: str, start: str | None = None, end: str | None = None) -> TimeRange:
    """The instants of a named range around now; unknown kinds mean this week, impossible custom bounds today."""
    today = now.astimezone(ZoneInfo(zone)).date()
    monday, first = today - timedelta(days=today.weekday()), today.replace(day=1)
    day = timedelta(days=1)
    a, b = (parse_bound(start), parse_bound(end)) if kind == "custom" else (None, None)
    if a and b:
        begin = datetime.combine(a[0], datetime.min.time()) + timedelta(hours=a[1] or 0)
        until = datetime.combine(b[0], datetime.min.time()) + (day if b[1] is None else timedelta(hours=b[1] + 1))
        if begin < until:
            return TimeRange(kind, zone, local_to_utc(begin, zone), local_to_utc(until, zone) - _MS)
    if kind == "custom":
        days = (today, today + day)
    else:
        last_month = (first - day).replace(day=1)
        next_month = (first + timedelta(days=32)).replace(day=1)
        days = {
            "today": (today, today + day),
            "yesterday": (today - day, today),
            "lastWeek": (monday - 7 * day, monday),
            "thisMonth": (first, next_month),
            "lastMonth": (last_month, first),
        }.get(kind, (monday, monday + 7 * day))
    a, b = (local_to_utc(datetime.combine(d, datetime.min.time()), zone) for d in days)
    return TimeRange(kind if kind in RANGE_KINDS else DEFAULT_KIND, zone, a, b - _MS)


def literal(at: datetime) -> Column:
    """An instant as a literal, whatever the zones of driver and session."""
    return F.timestamp_micros(F.lit(int(at.timestamp() * 1000) * 1000))


def day_bucket(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def _offset_minutes(ts: Column, zone: str) -> Column:
    return F.floor((F.unix_micros(F.from_utc_timestamp(ts, zone)) - F.unix_micros(ts)) / 60_000_000)


def hour_bucket(ts: Column, zone: str) -> Column:
    """Local hour with its offset, so the two hours of a clock change stay apart."""
    minutes = _offset_minutes(ts, zone)
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours, rest = F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH"), sign, two(hours), F.lit(":"), two(rest))


def bucket_start(ts: Column, zone: str, granularity: str) -> Column:
    """The instant at which the bucket of ts begins."""
    local = F.from_utc_timestamp(ts, zone)
    if granularity == "day":
        return local_to_utc_col(F.date_trunc("day", local), zone)
    # An hour begins at its own offset, also where the clock is put back.
    return F.timestamp_micros(F.unix_micros(F.date_trunc("hour", local)) - _offset_minutes(ts, zone) * 60_000_000)


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two instants; null if one is missing or they are in the wrong order."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return F.when(seconds >= 0, F.floor(seconds / 60))


def duration_text(minutes: Column) -> Column:
    """The two largest units of days, hours and minutes, as 1d 2h; <1m below a minute."""
    d, h, m = F.floor(minutes / 1440), F.floor(minutes / 60) % 24, minutes % 60
    part = lambda x, unit: F.when(x > 0, F.concat(x.cast("string"), F.lit(unit)))
    units = F.when(d > 0, F.concat_ws(" ", part(d, "d"), part(h, "h"))).otherwise(F.concat_ws(" ", part(h, "h"), part(m, "m")))
    return F.when(minutes < 1, F.lit("<1m")).when(minutes.isNotNull(), units)


def add_days(key: str, days: int) -> str:
    return (date.fromisoformat(key) + timedelta(days=days)).isoformat()
