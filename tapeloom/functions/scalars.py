"""Times and symbols as column expressions. Timestamps are instants; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epochs below this are seconds, from here on milliseconds; instants are valid from 2000 up to the end of 2100.
MILLIS_FROM = 100_000_000_000
FIRST_SECOND, LAST_SECOND = 946_684_800, 4_133_980_799
FIRST_INSTANT = "2000-01-01 00:00:00"
VIETNAM_HOURS = 7


def from_epoch_secs(epoch: Column) -> Column:
    """Null outside 2000..2100; the guard stands before the conversion, which would overflow."""
    return F.when(epoch.between(FIRST_SECOND, LAST_SECOND), F.timestamp_seconds(epoch))


def from_epoch_millis(epoch: Column) -> Column:
    return F.when(epoch.between(FIRST_SECOND * 1000, LAST_SECOND * 1000 + 999), F.timestamp_millis(epoch))


def from_raw_epoch(epoch: Column) -> Column:
    """Seconds or milliseconds, told by size."""
    return F.when(epoch < MILLIS_FROM, from_epoch_secs(epoch)).otherwise(from_epoch_millis(epoch))


def to_vietnam_time(ts: Column) -> Column:
    """The wall clock at UTC+7, which knows no summer time."""
    return ts + F.make_dt_interval(hours=F.lit(VIETNAM_HOURS))


def minus(ts: Column, seconds: Column | float) -> Column:
    """Null if the result falls before 2000."""
    back = ts - F.make_dt_interval(secs=F.lit(seconds) if not isinstance(seconds, Column) else seconds)
    return F.when(back >= F.timestamp_seconds(F.lit(FIRST_SECOND)), back)


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_symbol(text: Column) -> Column:
    return F.upper(trim_all(text))


def finite(x: Column) -> Column:
    """False for null, NaN and infinities; NaN is above infinity in Spark's order."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
