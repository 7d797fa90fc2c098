"""Projection to a target temperature: state, headline and detail of every device."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import MINUTE_MS
from emberline.functions.moments import clock, duration_label
from emberline.functions.numeric import MISSING, is_finite

# Limits of the projection (Fahrenheit per minute, minutes).
LEAST_ETA_RATE = 0.05
LEAST_COOLING_RATE = 0.02
LONGEST_ETA_MIN = 8 * 60
ROUNDING_MIN = 5


def heat_status(current_f: Column, rate_f: Column, observed_ms: Column, status: Column,
                active: Column, target_f: float, as_of_ms: int, zone: str) -> Column:
    """Struct (state, headline, detail); the first rule that applies decides."""
    def shown(state: str, headline: Column | str, detail: Column | str = "") -> Column:
        as_column = [c if isinstance(c, Column) else F.lit(c) for c in (headline, detail)]
        return F.struct(F.lit(state).alias("state"), as_column[0].alias("headline"),
                        as_column[1].alias("detail"))

    usable = (status == "live") & is_finite(current_f) & F.lit(math.isfinite(target_f))
    # Left null below the least rate, which also keeps the division from ever seeing a zero.
    minutes = F.when(is_finite(rate_f) & (rate_f >= LEAST_ETA_RATE),
                     (F.lit(float(target_f)) - current_f) / rate_f)
    hot_at_ms = observed_ms + minutes * MINUTE_MS
    remaining = (hot_at_ms - F.lit(as_of_ms)) / MINUTE_MS
    rounded = F.greatest(F.lit(ROUNDING_MIN), F.ceil(remaining / ROUNDING_MIN) * ROUNDING_MIN)
    rounding_ms = ROUNDING_MIN * MINUTE_MS
    rounded_hot_at = F.ceil(hot_at_ms / rounding_ms) * rounding_ms
    return (
        F.when(~F.coalesce(usable, F.lit(False)), shown("unavailable", MISSING, "UNAVAILABLE"))
        .when(current_f >= target_f, shown("hot", "HOT"))
        .when((remaining > 0) & (remaining <= LONGEST_ETA_MIN),
              shown("eta", duration_label(rounded), clock(rounded_hot_at, zone)))
        .when((rate_f > 0) & ~F.isnan(rate_f), shown("warming", "WARMING", "CALCULATING"))
        .when(rate_f < -LEAST_COOLING_RATE, shown("cooling", "COOLING"))
        .when(active, shown("heating", "HEATING", "CALCULATING"))
        .otherwise(shown("idle", "NOT HEATING"))
    )


def fleet_heat_status(summary: DataFrame, target_f: float, as_of_ms: int, zone: str) -> DataFrame:
    """Heat status of every device of a current summary."""
    projection = heat_status(
        F.col("current.sauna.f"), F.col("current.sauna.rate_f_per_min"), F.col("observed_at_ms"),
        F.col("status"), F.col("session_active"), target_f, as_of_ms, zone)
    return summary.withColumn("_heat", projection).select(
        "device_id", "status", "session_active", "_heat.*")
