"""Heating sessions with a start count, hysteresis and an end hold, per device.

A session opens at the N-th consecutive reading at or above the start temperature (dated back to the
first of them) and closes at a reading below the end temperature once the hold has passed since the
last reading at or above it; the end time is that last one.

Neither condition depends on whether a session is open, so the detector is a set/reset latch:

1. *Slices.*  Within (device, slice) one ordered pass marks set and reset rows.  Copies of earlier
   rows cover the run of start samples and the hold, so the marks of a slice's own rows are exact.
   Only changes are kept (a set after a set does nothing), and the rows between two changes are
   reduced to one partial aggregate.  Two changes of the same kind are at least one hold apart, so
   what is left of a device depends on the length of its history, not on its number of rows.
2. *Latch.*  A window over these few rows per device says where sessions open and close, and the
   partial aggregates of each session are combined.

The readings are shuffled once, on (device, slice), for rates and sessions together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.config import RuntimeConfig
from emberline.operators.rates import (
    ARRIVAL, DEVICE, detection_look_back, slice_length, sliced_rates, spread,
)
from emberline.operators.slices import OWN, SLICE, TIME

AIR, HEATER, HEATER_RATE = "sauna_temp_c", "stovepipe_temp_c", "stovepipe_rate_c_per_min"


def _marked(df: DataFrame, cfg: RuntimeConfig, arrival: tuple[str, ...]) -> DataFrame:
    """Mark set and reset rows; all windows share one order, so the rows are sorted once."""
    line = Window.partitionBy(DEVICE, SLICE).orderBy(TIME, *arrival)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    heater = F.col(HEATER)

    # Only the first reading of a time is seen by the detector; null is neither hot nor cold.
    df = df.withColumns({
        "_earlier": F.lag(TIME).over(line),
        "_row": F.row_number().over(line),
    })
    df = df.withColumn("_seen", F.col("_earlier").isNull() | (F.col("_earlier") < F.col(TIME)))
    df = df.withColumns({
        "_hot": F.col("_seen") & F.coalesce(heater >= cfg.start_c, F.lit(False)),
        "_warm_at": F.when(F.col("_seen") & (heater >= cfg.end_c), F.col(TIME)),
    })
    df = df.withColumns({
        "_seen_count": F.sum(F.when(F.col("_seen"), 1).otherwise(0)).over(upto),
        "_hot_before": F.last(F.when(F.col("_seen"), F.col("_hot")), True).over(before),
        "_last_warm": F.last("_warm_at", True).over(upto),
    })
    continues = (F.coalesce(F.col("_hot_before"), F.lit(False))
                 & (F.col(TIME) - F.col("_earlier") <= cfg.max_gap_ms))
    starts_run = F.col("_hot") & ~F.coalesce(continues, F.lit(False))
    df = df.withColumn("_run", F.last(F.when(starts_run, F.struct(
        F.col(TIME).alias("at"), F.col("_seen_count").alias("seen"),
        F.col("_row").alias("row"))), True).over(upto))
    return df.withColumns({
        "_set": F.col(OWN) & F.col("_hot")
        & (F.col("_seen_count") - F.col("_run.seen") + 1 == cfg.start_samples),
        "_reset": F.col(OWN) & F.col("_seen") & F.coalesce(heater < cfg.end_c, F.lit(False))
        & F.coalesce(F.col(TIME) - F.col("_last_warm") >= cfg.hold_ms, F.lit(True)),
    })


def _stretches(marked: DataFrame, arrival: tuple[str, ...]) -> DataFrame:
    """One row per stretch between changes: it may begin with a set row and end with a reset row."""
    line = Window.partitionBy(DEVICE, SLICE).orderBy(TIME, *arrival)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)

    mark = F.when(F.col("_set"), F.lit(1)).when(F.col("_reset"), F.lit(0))
    df = marked.withColumn("_mark", mark).withColumns({
        "_mark_before": F.last("_mark", True).over(before),
        # Highest values of the current run: the run's start leads the comparison and only grows.
        **{f"_run_{name}": F.max(F.struct(F.col("_run.at"), F.col(value).alias("v"))).over(upto)
           for name, value in (("air", AIR), ("heater", HEATER), ("rate", HEATER_RATE))},
    })
    df = df.withColumn("_change", F.when(~F.col("_mark").eqNullSafe(F.col("_mark_before")), F.col("_mark")))
    df = df.withColumn("_stretch", (
        F.sum(F.when(F.col("_change") == 1, 1).otherwise(0)).over(upto)
        + F.coalesce(F.sum(F.when(F.col("_change") == 0, 1).otherwise(0)).over(before), F.lit(0))))

    opens, closes = F.col("_change") == 1, F.col("_change") == 0
    seen = F.col("_seen")
    return df.where(F.col(OWN)).groupBy(DEVICE, SLICE, "_stretch").agg(
        F.max(F.when(opens, F.col("_run.at"))).alias("opens_at"),
        F.max(F.when(opens, F.col("_row") - F.col("_run.row"))).alias("run_rows"),
        F.max(F.when(opens, F.col("_run_air.v"))).alias("run_air"),
        F.max(F.when(opens, F.col("_run_heater.v"))).alias("run_heater"),
        F.max(F.when(opens, F.col("_run_rate.v"))).alias("run_rate"),
        F.max(closes).alias("closes"),
        F.max(F.when(closes, F.col("_last_warm"))).alias("closes_at"),
        F.max("_warm_at").alias("warm_at"),
        F.max(F.when(seen, F.col(AIR))).alias("air"),
        F.max(F.when(seen, F.col(HEATER))).alias("heater"),
        F.max(F.when(seen, F.col(HEATER_RATE))).alias("rate"),
        F.count(F.when(seen, 1)).alias("rows"),
    )


def _latched(stretches: DataFrame) -> DataFrame:
    """Run the latch over a device's stretches and combine those of each session."""
    line = Window.partitionBy(DEVICE).orderBy(SLICE, "_stretch")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)

    leaves_open = F.when(F.col("closes"), F.lit(0)).when(F.col("opens_at").isNotNull(), F.lit(1))
    df = stretches.withColumns({
        "_open_before": F.coalesce(F.last(leaves_open, True).over(before), F.lit(0)) == 1,
        "_warm_before": F.last("warm_at", True).over(before),
    })
    df = df.withColumns({
        "_opened": F.col("opens_at").isNotNull() & ~F.col("_open_before"),
        "_active": F.col("opens_at").isNotNull() | F.col("_open_before"),
    })
    df = df.withColumns({
        "started_at_ms": F.last(F.when(F.col("_opened"), F.col("opens_at")), True).over(upto),
        "_ended": F.when(F.col("closes"), F.coalesce("closes_at", "_warm_before")),
    })

    def opening(run: str) -> Column:
        return F.when(F.col("_opened"), F.col(run))

    return (
        df.where("_active").groupBy(DEVICE, "started_at_ms").agg(
            F.max("_ended").alias("ended_at_ms"),
            F.coalesce(F.max("_ended"), F.max("warm_at")).alias("last_hot_at_ms"),
            F.max(F.greatest("air", opening("run_air"))).alias("peak_sauna_c"),
            F.max(F.greatest("heater", opening("run_heater"))).alias("peak_stovepipe_c"),
            F.max(F.greatest("rate", opening("run_rate"))).alias("max_stovepipe_rate_c_per_min"),
            F.sum(F.col("rows") + F.coalesce(opening("run_rows"), F.lit(0))).alias("sample_count"),
        )
        .withColumn("complete", F.col("ended_at_ms").isNotNull().cast("int"))
    )


def detect_sessions(readings: DataFrame, cfg: RuntimeConfig, arrival: tuple[str, ...] = ARRIVAL,
                    stored_rates: bool = False) -> DataFrame:
    """All sessions of all devices, with their metrics, recomputed from the readings.

    Changed thresholds only mean another ``cfg``.  Rates are computed on the way, in the same
    shuffle, unless ``stored_rates`` says that the readings carry them.
    """
    look_back = detection_look_back(cfg)
    columns = [DEVICE, TIME, *arrival, AIR, HEATER]
    narrow = readings.select(*columns, *([HEATER_RATE] if stored_rates else []))
    sliced = spread(narrow, slice_length(look_back, cfg), look_back)
    if not stored_rates:
        sliced = sliced_rates(sliced, cfg, arrival, {HEATER: HEATER_RATE}, own_only=False)
    return _latched(_stretches(_marked(sliced, cfg, arrival), arrival))


def active_devices(readings: DataFrame, cfg: RuntimeConfig, arrival: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """The devices that are in a session: those whose last change of the latch is a set.

    Needs neither rates nor the sessions' metrics; a device leaves one row per task.
    """
    look_back = detection_look_back(cfg)
    narrow = readings.select(DEVICE, TIME, *arrival, HEATER)
    marked = _marked(spread(narrow, slice_length(look_back, cfg), look_back), cfg, arrival)
    changes = marked.where("_set OR _reset").select(DEVICE, TIME, "_set")
    # Of readings of one time the detector sees the first only, so a time has one change.
    return changes.groupBy(DEVICE).agg(F.max_by("_set", TIME).alias("_set")).where("_set").select(DEVICE)


def open_sessions(sessions: DataFrame) -> DataFrame:
    """The newest open session of each device."""
    return sessions.where("ended_at_ms IS NULL").groupBy(DEVICE).agg(
        F.max("started_at_ms").alias("started_at_ms"),
        F.max_by("last_hot_at_ms", "started_at_ms").alias("last_hot_at_ms"),
    )


def any_open_session(sessions: DataFrame) -> bool:
    return not sessions.where("ended_at_ms IS NULL").limit(1).isEmpty()


def sessions_since(sessions: DataFrame, since_ms: int) -> DataFrame:
    """Sessions started at or after a time, oldest first."""
    return sessions.where(F.col("started_at_ms") >= since_ms).orderBy("started_at_ms", DEVICE)
