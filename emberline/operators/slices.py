"""Time slices: how per-device computations are spread when one device holds most of the data.

A window over ``device_id`` alone puts a device's whole history into one task.  Instead a device's
time line is cut into slices of fixed length, the shuffle key is (device, slice), and every row is
also given to later slices that must look back at it.  The work of one task is then bounded by the
length of a slice, whatever share of the rows one device has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import RuntimeConfig

TIME = "observed_at_ms"
SLICE = "_slice"
OWN = "_own"

# A slice is this many look-back spans long: short enough that a device is many slices, at the
# price of a copy of about every second row in the next slice.
SPANS_PER_SLICE = 2


def slice_length(look_back_ms: int, cfg: RuntimeConfig) -> int:
    """Slice length in ms: a whole number of rate windows, so that a window's block never straddles."""
    wanted = SPANS_PER_SLICE * max(look_back_ms, cfg.window_ms)
    return -(-wanted // cfg.window_ms) * cfg.window_ms


def number_of(time: Column, length_ms: int) -> Column:
    """Number of the fixed-length period a time falls into (also for times before 1970)."""
    return F.floor((time - F.pmod(time, F.lit(length_ms))) / F.lit(length_ms))


def spread(df: DataFrame, length_ms: int, look_back_ms: int) -> DataFrame:
    """Give every row to its own slice and to the next ones within ``look_back_ms`` of it."""
    home = number_of(F.col(TIME), length_ms)
    last = number_of(F.col(TIME) + F.lit(look_back_ms), length_ms)
    return (
        df.withColumn(SLICE, F.explode(F.sequence(home, last)))
        .withColumn(OWN, F.col(SLICE) == home)
    )
