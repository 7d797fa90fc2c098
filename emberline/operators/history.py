"""Downsampled history: range, bucket size, aggregates, long form, segments and readouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import MINUTE_MS, RuntimeConfig
from emberline.functions import numeric as N
from emberline.functions.moments import iso_utc
from emberline.operators.rates import ARRIVAL, gap_segments, with_rates
from emberline.operators.slices import TIME

HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# The named ranges and the bucket sizes of an open-ended history.
RANGES: dict[str, int | None] = {
    "1h": HOUR_MS, "3h": 3 * HOUR_MS, "12h": 12 * HOUR_MS, "24h": DAY_MS,
    "7d": 7 * DAY_MS, "30d": 30 * DAY_MS, "all": None,
}
DEFAULT_RANGE = "24h"
BUCKETS = (5 * MINUTE_MS, 15 * MINUTE_MS, HOUR_MS, 3 * HOUR_MS, 6 * HOUR_MS, 12 * HOUR_MS,
           DAY_MS, 7 * DAY_MS)
COARSER_BUCKETS = {"7d": 15 * MINUTE_MS, "30d": HOUR_MS}
TARGET_BUCKETS = 1_500

# Series labels and the column prefixes they come from.
SERIES = {"Sauna air": "sauna", "Stovepipe": "stovepipe"}


def history_range(name: str | None) -> tuple[str, int | None]:
    """Name and duration of a range; an unknown name means the default range."""
    known = name if name in RANGES else DEFAULT_RANGE
    return known, RANGES[known]


def history_bucket_ms(range_name: str, span_ms: int, interval_ms: int) -> int:
    """Bucket length that keeps the number of points of a range bounded."""
    if range_name != "all":
        return max(interval_ms, COARSER_BUCKETS.get(range_name, interval_ms))
    least = max(interval_ms, -(-span_ms // TARGET_BUCKETS))
    return next((bucket for bucket in BUCKETS if bucket >= least), BUCKETS[-1])


def oldest_reading_time(readings: DataFrame) -> DataFrame:
    return readings.agg(F.min(TIME).alias("oldest"))


@dataclass(frozen=True)
class HistoryBounds:
    """A history request in numbers: half-open [from_ms, to_ms) and its bucket length."""

    range_name: str
    from_ms: int
    to_ms: int
    bucket_ms: int

    @classmethod
    def of(cls, readings: DataFrame, range_name: str | None, as_of_ms: int,
           cfg: RuntimeConfig) -> HistoryBounds:
        """Look up the oldest reading (one MIN over one column) and fix bounds and bucket."""
        name, duration = history_range(range_name)
        oldest = oldest_reading_time(readings).first()["oldest"]
        if duration is None:
            start = as_of_ms if oldest is None else oldest
        else:
            start = max(as_of_ms - duration, as_of_ms - duration if oldest is None else oldest)
        bucket = history_bucket_ms(name, max(0, as_of_ms - start), cfg.interval_ms)
        return cls(name, start, as_of_ms + 1, bucket)

    def within(self, readings: DataFrame) -> DataFrame:
        return readings.where(F.col(TIME).between(self.from_ms, self.to_ms - 1))

    def max_gap_ms(self, cfg: RuntimeConfig) -> float:
        return max(self.bucket_ms, cfg.expected_interval_s * 1_000) * 2.5


def rates_within(readings: DataFrame, bounds: HistoryBounds, cfg: RuntimeConfig,
                 arrival: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Readings of the range with their rates, reading only one rate window more than the range."""
    wider = readings.where(F.col(TIME).between(bounds.from_ms - cfg.window_ms, bounds.to_ms - 1))
    return bounds.within(with_rates(wider, cfg, arrival))


def downsample(readings: DataFrame, bounds: HistoryBounds, by: tuple[str, ...] = ()) -> DataFrame:
    """Average, lowest and highest per bucket, over all devices or ``by`` device.

    Means are exact sums and one division, so they are the same however the partial sums meet.
    """
    time, width = F.col(TIME), F.lit(bounds.bucket_ms)
    bucketed = bounds.within(readings).withColumn("bucket_ms", time - time % width)
    aggregates = []
    for prefix in SERIES.values():
        value = F.col(f"{prefix}_temp_c")
        aggregates += [N.exact_mean(value).alias(f"{prefix}_avg_c"), F.min(value).alias(f"{prefix}_min_c"),
                       F.max(value).alias(f"{prefix}_max_c")]
    aggregates += [N.exact_mean(F.col(f"{prefix}_rate_c_per_min")).alias(f"{prefix}_rate_avg_c_per_min")
                   for prefix in SERIES.values()]
    grouped = bucketed.groupBy(*by, "bucket_ms").agg(
        F.sum(time - F.col("bucket_ms")).alias("_offsets"), F.count("*").alias("_rows"), *aggregates)
    point = F.col("bucket_ms") + F.expr("_offsets div _rows")
    return grouped.withColumn("point_ms", point).select(
        *by, "bucket_ms", "point_ms", *[c for c in grouped.columns if c not in (
            *by, "bucket_ms", "_offsets", "_rows")])


def to_long_form(buckets: DataFrame, unit: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per bucket and series that has values, in the requested unit."""
    def point(series: str, prefix: str) -> Column:
        return F.struct(
            F.lit(series).alias("series"),
            N.temperature(F.col(f"{prefix}_avg_c"), unit).alias("temp"),
            N.temperature(F.col(f"{prefix}_min_c"), unit).alias("temp_min"),
            N.temperature(F.col(f"{prefix}_max_c"), unit).alias("temp_max"),
            N.rate(F.col(f"{prefix}_rate_avg_c_per_min"), unit).alias("rate"),
        )

    points = F.array(*[point(series, prefix) for series, prefix in SERIES.items()])
    return (
        buckets.select(*by, "point_ms", F.explode(points).alias("_p"))
        .where("_p.temp IS NOT NULL")
        .select(*by, "point_ms", iso_utc(F.col("point_ms")).alias("ts"), "_p.*")
    )


def history_segments(points: DataFrame, max_gap_ms: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Number the stretches of each series between gaps.

    This window runs after downsampling: a series has about 1,500 points, however many readings
    and devices went into them.
    """
    return gap_segments(points, max_gap_ms, (*by, "series"), ("point_ms",))


@dataclass(frozen=True)
class History:
    """The answer to a history request: its bounds and units, and its points."""

    bounds: HistoryBounds
    unit: str
    as_of_ms: int
    points: DataFrame

    def described(self) -> DataFrame:
        """The points, each with the request's range, bounds, bucket and units."""
        facts = {
            "range": F.lit(self.bounds.range_name), "from": iso_utc(F.lit(self.bounds.from_ms)), "to": iso_utc(F.lit(self.as_of_ms)),
            "bucket_seconds": F.lit(self.bounds.bucket_ms / 1_000), "unit": F.lit(self.unit),
            "temperature_unit": F.lit(f"°{self.unit.upper()}"), "rate_unit": F.lit(f"°{self.unit.upper()}/min"),
        }
        return self.points.select(*[value.alias(name) for name, value in facts.items()], *self.points.columns)


def history_request(readings: DataFrame, range_name: str | None, as_of_ms: int, cfg: RuntimeConfig,
                    unit: str | None = None, by: tuple[str, ...] = ()) -> History:
    """A whole request over readings that carry their rates: any range name, any unit name."""
    bounds, known = HistoryBounds.of(readings, range_name, as_of_ms, cfg), N.requested_unit(unit)
    points = to_long_form(downsample(readings, bounds, by), known, by)
    return History(bounds, known, as_of_ms, history_segments(points, bounds.max_gap_ms(cfg), by).drop("point_ms"))


def history(readings: DataFrame, range_name: str | None, as_of_ms: int, cfg: RuntimeConfig,
            unit: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Long-form history points of readings that carry their rates."""
    return history_request(readings, range_name, as_of_ms, cfg, unit, by).points


def history_readouts(points: DataFrame, unit: str = "f") -> DataFrame:
    """Texts shown with a point: temperature or temperature span, and the signed rate per hour."""
    sign = F.lit(f" °{unit.upper()}")
    per_hour = F.col("rate") * 60
    low, high = N.fixed(F.col("temp_min"), 1), N.fixed(F.col("temp_max"), 1)
    return points.withColumns({
        "rate_per_hour": per_hour,
        "temperature_readout": F.when(F.col("temp_min") == F.col("temp_max"), F.concat(high, sign))
        .otherwise(F.concat(low, F.lit("–"), high, sign)),
        "rate_readout": F.when(per_hour.isNotNull(), F.concat(
            F.when(per_hour > 0, "+").otherwise(""), N.fixed(per_hour, 1),
            sign, F.lit("/hour"))),
    })


def with_valid_rate(points: DataFrame) -> DataFrame:
    """The points a rate chart shows."""
    return points.where(N.is_finite(F.col("rate")))


