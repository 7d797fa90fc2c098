"""Epoch milliseconds, ISO text, months and clocks in a time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the accepted shapes of an ISO 8601 / RFC 3339 instant, from a year to a full instant.
_YEAR = r"^\d{4}$"
_MONTH = r"^\d{4}-\d{2}$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_CLOCK = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def epoch_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO instant, null when the text is none.

    Text without an offset is UTC.  Digits beyond the millisecond are dropped.
    """
    full = (
        F.when(text.rlike(_INSTANT), text)
        .when(text.rlike(_CLOCK), F.concat(text, F.lit("Z")))
        .when(text.rlike(_DAY), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(_MONTH), F.concat(text, F.lit("-01T00:00:00Z")))
        .when(text.rlike(_YEAR), F.concat(text, F.lit("-01-01T00:00:00Z")))
    )
    return F.unix_millis(full.try_cast("timestamp"))


def instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_utc(ms: Column) -> Column:
    return F.date_format(instant(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local(ms: Column, zone: str) -> Column:
    """Wall-clock time of an instant in a zone (the session itself runs in UTC)."""
    return F.from_utc_timestamp(instant(ms), zone)


def month_key(ms: Column, zone: str) -> Column:
    return F.date_format(local(ms, zone), "yyyy-MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def clock(ms: Column, zone: str) -> Column:
    """Twelve-hour wall clock, such as 2:10 PM."""
    return F.date_format(local(ms, zone), "h:mm a")


def duration_label(minutes: Column) -> Column:
    """45M, 2H or 2H 30M for a whole number of minutes."""
    hours = F.floor(minutes / 60).cast("string")
    rest = (minutes % 60).cast("string")
    return (
        F.when(minutes < 60, F.concat(rest, F.lit("M")))
        .when(minutes % 60 == 0, F.concat(hours, F.lit("H")))
        .otherwise(F.concat(hours, F.lit("H "), rest, F.lit("M")))
    )
