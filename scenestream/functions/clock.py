"""Time helpers on BIGINT milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ms: Column, zone: Column | str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def with_offset(ms: Column, offset_seconds: Column) -> Column:
    """Apply a camera's clock offset."""
    return ms + F.round(offset_seconds * 1000).cast("bigint")


def bucket_start(ms: Column, width_ms: int) -> Column:
    return (F.floor(ms / F.lit(width_ms)) * F.lit(width_ms)).cast("bigint")


def ntz_millis(ts: str) -> Column:
    """Milliseconds of a zone-less timestamp column, read as UTC whatever the session zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def in_active_hours(
    ms: Column, start: str | Column, end: str | Column, days: Sequence[int] | Column, zone: Column | str = "UTC"
) -> Column:
    """Weekday (0 = Monday) and inclusive HH:MM range; a range with start > end passes midnight. The limits may be columns (days an array)."""
    t = local_time(ms, zone)
    hhmm = F.date_format(t, "HH:mm")
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    hours = F.when(lo <= hi, (hhmm >= lo) & (hhmm <= hi)).otherwise((hhmm >= lo) | (hhmm <= hi))
    listed = days if isinstance(days, Column) else F.array(*[F.lit(int(d)) for d in days]).cast("array<int>")
    return hours & F.array_contains(listed, F.weekday(t))


def sample_interval(fps: Column, fps_sample: Column) -> Column:
    """Keep every n-th frame: n = max(1, round-half-even(fps / fps_sample))."""
    return F.greatest(F.lit(1), F.bround(fps / fps_sample, 0).cast("int"))
