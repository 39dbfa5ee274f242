"""Time and ordering helpers as Column expressions (no time-zone math for
TIMESTAMP_NTZ): ordered bucket ids for the skew-safe scans, epoch seconds,
exact durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


TIME_BUCKET_UNIT = "MINUTE"


def time_bucket(ts: str | Column, unit: str = TIME_BUCKET_UNIT) -> Column:
    """Bucket for time-ordered scans: whole ``unit``s since 1970 (never
    decreases with ``ts``; for TIMESTAMP_NTZ no time-zone arithmetic).

    Minutes by default: a run holding a third of 100 TB over a month is
    split into ~43k buckets of under 1 GB, while the carry window sees at
    most one summary row per minute of a run."""
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def hour_bucket(ts: str | Column) -> Column:
    """Hour buckets (coarser; fewer summary rows for dense, short runs)."""
    return time_bucket(ts, "HOUR")


def int_bucket(c: str | Column, width: int) -> Column:
    """Bucket for integer-ordered scans: ``c div width``."""
    return F.floor(_c(c) / F.lit(width)).cast("bigint")


def epoch_seconds(ts: str | Column, dtype: T.DataType | None = None) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock timestamp, computed
    without the session time zone for TIMESTAMP_NTZ input."""
    c = _c(ts)
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(c)
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Exact microseconds from ``start`` to ``end`` (no time-zone math)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def ms_between(start: str | Column, end: str | Column) -> Column:
    """Whole milliseconds from ``start`` to ``end`` (floor)."""
    return F.floor(micros_between(start, end) / F.lit(1000)).cast("bigint")
