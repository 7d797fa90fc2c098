"""Sessions by calendar month of a reporting time zone."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions.moments import month_key, month_label
from emberline.functions.numeric import half_up

DEFAULT_MONTHS, MOST_MONTHS = 12, 36


def month_count(requested: object = DEFAULT_MONTHS) -> int:
    """Number of months asked for, 12 when it is not whole, kept within 1 and 36."""
    if isinstance(requested, str) and not requested.strip():
        requested = 0
    try:
        number = float(requested)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return DEFAULT_MONTHS
    if number != number or number in (float("inf"), float("-inf")) or number % 1:
        return DEFAULT_MONTHS
    return int(min(MOST_MONTHS, max(1, number)))


def local_month(as_of_ms: int, zone: str) -> date:
    """First day of the month an instant falls into, in the zone."""
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=as_of_ms)
    return moment.astimezone(ZoneInfo(zone)).date().replace(day=1)


def month_spine(spark: SparkSession, months: int, as_of_ms: int, zone: str) -> DataFrame:
    """The last months up to the current one, oldest first: at most 36 rows."""
    current = F.lit(local_month(as_of_ms, zone))
    first_days = F.sequence(F.add_months(current, 1 - months), current, F.expr("interval 1 month"))
    days = spark.range(1).select(F.explode(first_days).alias("_day"))
    return days.select(
        F.date_format("_day", "yyyy-MM").alias("month"),
        month_label(F.col("_day")).alias("label"),
        (F.col("_day") == current).alias("partial"),
    )


def look_back_start_ms(months: int, as_of_ms: int, zone: str) -> int:
    """A start time that is early enough for the first month in any zone: a filter that prunes."""
    current = local_month(as_of_ms, zone)
    index = current.year * 12 + current.month - months
    first = datetime(index // 12, index % 12 + 1, 1, tzinfo=timezone.utc) - timedelta(days=2)
    return int(first.timestamp() * 1_000)


def sessions_by_month(sessions: DataFrame, months: int, as_of_ms: int, zone: str) -> DataFrame:
    """Count, hours and mean duration of the sessions begun in each month; empty months stay.

    Durations are whole milliseconds up to the final division, so sums are exact.
    """
    recent = sessions.where(F.col("started_at_ms") >= look_back_start_ms(months, as_of_ms, zone))
    length = F.greatest(F.lit(0), F.coalesce("ended_at_ms", F.lit(as_of_ms)) - F.col("started_at_ms"))
    by_month = recent.groupBy(month_key(F.col("started_at_ms"), zone).alias("month")).agg(
        F.count("*").alias("sessions"), F.sum(length).alias("_ms"),
        F.sum("complete").alias("complete_sessions"))
    minutes = F.coalesce("_ms", F.lit(0)) / F.lit(60_000.0)
    spine = month_spine(sessions.sparkSession, months, as_of_ms, zone)
    return spine.join(by_month, "month", "left").select(
        "month", "label",
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        half_up(minutes / 60, 1).alias("total_hours"),
        half_up(F.when(F.col("sessions") > 0, minutes / F.col("sessions")), 0)
        .alias("average_duration_minutes"),
        "partial",
        F.coalesce("complete_sessions", F.lit(0)).alias("complete_sessions"),
    )
