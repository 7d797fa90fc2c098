"""Rolling least-squares rate of each channel in a trailing time window.

A row's sample is the rows of its device in [t - W, t] (both ends included, rows at the same time
only as far as they arrived before), cut at the last gap longer than the allowed one.

Evaluating such a frame row by row costs rows x frame size, which a densely reporting device cannot
afford.  Here time is cut into blocks of exactly W.  A frame is then the tail of the previous block
plus the head of the row's own block, so two running sums per block are enough:

* head: sums over the block's rows up to the current one, in time order;
* tail: rows of the previous block are moved forward by W and mixed into the block; going backwards
  in time, the sums over the moved rows met so far cover exactly the previous block's rows >= t - W.

Nothing is ever subtracted, so one absurd value cannot disturb frames it is not part of.  All steps
share one shuffle on (device, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.config import MINUTE_MS, RuntimeConfig
from emberline.functions.numeric import is_finite
from emberline.operators.slices import OWN, SLICE, TIME, number_of, slice_length, spread

DEVICE = "device_id"
ARRIVAL = ("inserted_at_ms", "message_key")
# Channel column -> rate column.
CHANNELS = {
    "sauna_temp_c": "sauna_rate_c_per_min",
    "stovepipe_temp_c": "stovepipe_rate_c_per_min",
}


def gap_segments(df: DataFrame, max_gap_ms: int, keys: tuple[str, ...],
                 order: tuple[str, ...], name: str = "segment") -> DataFrame:
    """Number the stretches between gaps longer than ``max_gap_ms``, from 0 within each key."""
    line = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(order[0]) - F.lag(order[0]).over(line)
    return (
        df.withColumn("_gap", gap)
        .withColumn(name, F.sum(F.when(F.col("_gap") > max_gap_ms, 1).otherwise(0)).over(
            line.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_gap")
    )


def _sums(time: Column, origin: Column, value: Column, counted: Column, prefix: str,
          frame: Window) -> dict[str, Column]:
    """Running sums of a regression of ``value`` on minutes since ``origin``."""
    x = F.when(counted, (time - origin) / F.lit(float(MINUTE_MS)))
    y = F.when(counted, value)
    return {
        f"{prefix}n": F.count(y).over(frame),
        f"{prefix}x": F.sum(x).over(frame),
        f"{prefix}y": F.sum(y).over(frame),
        f"{prefix}xx": F.sum(x * x).over(frame),
        f"{prefix}xy": F.sum(x * y).over(frame),
        f"{prefix}from": F.min(F.when(counted, time)).over(frame),
        f"{prefix}to": F.max(F.when(counted, time)).over(frame),
    }


def _slope(head: str, tail: str, span_ms: int) -> Column:
    """Slope per minute of head and tail together, null without three samples over the least span."""
    def total(part: str) -> Column:
        return F.coalesce(F.col(head + part), F.lit(0)) + F.coalesce(F.col(tail + part), F.lit(0))

    n, x, y, xx, xy = (total(part) for part in ("n", "x", "y", "xx", "xy"))
    first = F.least(F.col(head + "from"), F.col(tail + "from"))
    last = F.greatest(F.col(head + "to"), F.col(tail + "to"))
    spread_x = n * xx - x * x
    return F.when((n >= 3) & (last - first >= span_ms) & (spread_x > 0),
                  (n * xy - x * y) / spread_x)


def sliced_rates(sliced: DataFrame, cfg: RuntimeConfig, arrival: tuple[str, ...] = ARRIVAL,
                 channels: dict[str, str] | None = None, own_only: bool = True) -> DataFrame:
    """Add the rate columns to rows spread over slices; ``own_only`` drops the copies afterwards."""
    channels = channels or CHANNELS
    window_ms = cfg.window_ms
    place = (DEVICE, SLICE, "_segment", "_block")
    length_ms = slice_length(detection_look_back(cfg), cfg)

    df = gap_segments(sliced, cfg.max_gap_ms, (DEVICE, SLICE), (TIME, *arrival), "_segment")
    df = df.withColumn("_block", number_of(F.col(TIME), window_ms))

    head_frame = Window.partitionBy(*place).orderBy(TIME, *arrival).rowsBetween(
        Window.unboundedPreceding, 0)
    start = F.col("_block") * F.lit(window_ms)
    heads: dict[str, Column] = {}
    for index, value in enumerate(channels):
        heads |= _sums(F.col(TIME), start, F.col(value), is_finite(F.col(value)),
                       f"_head{index}_", head_frame)
    df = df.withColumns(heads)

    # Every row once as itself and once moved into the next block, there without its other columns.
    needed = {DEVICE, SLICE, "_segment", "_block", TIME, *channels}
    df = df.withColumn("_moved", F.explode(F.array(F.lit(0), F.lit(1))))
    df = df.select(
        *[F.col(c) if c in needed else F.when(F.col("_moved") == 0, F.col(c)).alias(c)
          for c in df.columns if c not in ("_moved", "_block")],
        "_moved",
        (F.col("_block") + F.col("_moved")).alias("_block"),
    )
    df = df.where((F.col("_moved") == 1) | F.col(OWN)) if own_only else df
    # A copy beyond the slice's end serves no row of the slice.
    df = df.where((F.col("_moved") == 0)
                  | (F.col("_block") * window_ms < (F.col(SLICE) + 1) * length_ms))

    position = F.col(TIME) + F.col("_moved") * F.lit(window_ms)
    tail_frame = (Window.partitionBy(*place).orderBy(position.desc(), F.col("_moved").desc())
                  .rowsBetween(Window.unboundedPreceding, 0))
    start = F.col("_block") * F.lit(window_ms)
    tails: dict[str, Column] = {}
    for index, value in enumerate(channels):
        tails |= _sums(F.col(TIME), start, F.col(value),
                       (F.col("_moved") == 1) & is_finite(F.col(value)),
                       f"_tail{index}_", tail_frame)
    df = df.withColumns(tails).where("_moved = 0")

    rates = {rate: _slope(f"_head{i}_", f"_tail{i}_", cfg.span_ms)
             for i, rate in enumerate(channels.values())}
    return df.withColumns(rates).drop(
        "_moved", "_block", "_segment", *heads, *tails)


def detection_look_back(cfg: RuntimeConfig) -> int:
    """How far back a slice must see for exact rates and session events of its own rows.

    Session events need the end hold, a run of start samples and the row before it; the rates of
    those samples need their own window.
    """
    run = cfg.start_samples * cfg.max_gap_ms
    return max(cfg.hold_ms, run, run - cfg.max_gap_ms + cfg.window_ms)


def with_rates(readings: DataFrame, cfg: RuntimeConfig,
               arrival: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Attach both rates to every reading (the complete recomputation in event-time order)."""
    base = readings.drop(*CHANNELS.values())
    length_ms = slice_length(detection_look_back(cfg), cfg)
    sliced = spread(base, length_ms, cfg.window_ms)
    return sliced_rates(sliced, cfg, arrival).drop(SLICE, OWN)
