"""Latest state of a fleet: newest reading, freshness, session activity and display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import RuntimeConfig
from emberline.functions import numeric as N
from emberline.functions.moments import iso_utc
from emberline.operators.rates import ARRIVAL, DEVICE, with_rates
from emberline.operators.slices import TIME


def age_seconds(observed_ms: Column, as_of_ms: int) -> Column:
    """Whole seconds since the observation; a reading from the future has age 0."""
    return F.greatest(F.lit(0), F.floor((F.lit(as_of_ms) - observed_ms) / 1_000))


def freshness(observed_ms: Column, as_of_ms: int, cfg: RuntimeConfig) -> Column:
    age = age_seconds(observed_ms, as_of_ms)
    return (
        F.when(observed_ms.isNull(), "offline")
        .when(age <= cfg.expected_interval_s * 2, "live")
        .when(age <= cfg.stale_after_s, "delayed")
        .otherwise("stale")
    )


def current_readings(readings: DataFrame, cfg: RuntimeConfig,
                     arrival: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """The newest reading of each device, with its rates.

    Only one rate window before a device's newest reading is looked at: the newest times (a hash
    aggregate over two columns) are joined to the readings before any rate is computed, and the
    newest of the few rows that remain is taken in one aggregate.
    """
    newest = readings.groupBy(DEVICE).agg(F.max(TIME).alias("_newest"))
    recent = readings.join(newest, DEVICE).where(
        F.col(TIME) >= F.col("_newest") - F.lit(cfg.window_ms)).drop("_newest")
    rated = with_rates(recent, cfg, arrival)
    rest = [c for c in rated.columns if c != DEVICE]
    return rated.groupBy(DEVICE).agg(F.max_by(F.struct(*rest), F.struct(TIME, "message_key")).alias("_r")).select(
        DEVICE, "_r.*").select(*rated.columns)


def current_summary(current: DataFrame, active: DataFrame, as_of_ms: int, cfg: RuntimeConfig,
                    devices: DataFrame | None = None) -> DataFrame:
    """State of each device; ``devices`` names all of them, those without any reading are offline.

    ``current`` holds one row per device, ``active`` the devices in a session: both joins are one to one.
    """
    active = active.select(DEVICE, F.lit(True).alias("_active"))
    rows = current if devices is None else devices.select(DEVICE).join(current, DEVICE, "left")

    def probe(prefix: str) -> Column:
        temp, rate = F.col(f"{prefix}_temp_c"), F.col(f"{prefix}_rate_c_per_min")
        return F.struct(
            N.half_up(temp, 2).alias("c"), N.temperature(temp, "f").alias("f"),
            N.half_up(rate, 3).alias("rate_c_per_min"), N.rate(rate, "f").alias("rate_f_per_min"),
        ).alias(prefix)

    state = F.struct(
        iso_utc(F.col(TIME)).alias("observed_at"),
        age_seconds(F.col(TIME), as_of_ms).alias("age_seconds"),
        probe("sauna"), probe("stovepipe"),
        N.half_up(F.col("battery_v"), 3).alias("battery_v"),
        F.struct(N.half_up(F.col("rssi_dbm"), 1).alias("rssi_dbm"),
                 N.half_up(F.col("snr_db"), 1).alias("snr_db")).alias("signal"),
    )
    return rows.join(active, DEVICE, "left").select(
        DEVICE,
        F.lit(cfg.site_name).alias("site_name"),
        F.lit(cfg.time_zone).alias("time_zone"),
        F.lit(float(cfg.rate_window_min)).alias("rate_window_minutes"),
        freshness(F.col(TIME), as_of_ms, cfg).alias("status"),
        F.lit(float(cfg.expected_interval_s)).alias("expected_interval_seconds"),
        F.lit(float(cfg.stale_after_s)).alias("stale_after_seconds"),
        # A device without readings has no session either.
        F.coalesce("_active", F.lit(False)).alias("session_active"),
        F.col(TIME).alias(TIME),
        F.when(F.col(TIME).isNotNull(), state).alias("current"),
    )


def display_snapshot(current: DataFrame) -> DataFrame:
    """Whole-degree Fahrenheit texts of each device, a dash for a missing probe."""
    def whole(column: str) -> Column:
        return N.fixed(N.temperature(F.col(column), "f"), 0)

    return current.select(
        DEVICE,
        iso_utc(F.col(TIME)).alias("observed_at"),
        whole("sauna_temp_c").alias("sauna_f"),
        whole("stovepipe_temp_c").alias("stovepipe_f"),
    )


