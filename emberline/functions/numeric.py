"""Number conversion, rounding and formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING = "—"
_EXACT = float(2**52)  # doubles of this size and beyond have no fraction
_INFINITY = float("inf")


def is_finite(x: Column) -> Column:
    """True for a real number; NaN sorts above infinity in Spark, so one comparison is enough."""
    return x.isNotNull() & (F.abs(x) < F.lit(_INFINITY))


def c_to_f(x: Column) -> Column:
    return x * F.lit(1.8) + F.lit(32.0)


def c_rate_to_f(x: Column) -> Column:
    return x * F.lit(1.8)


def half_up(x: Column, digits: int = 2) -> Column:
    """Round with halves towards plus infinity; null for null, NaN and infinity."""
    scale = F.lit(float(10**digits))
    scaled = x * scale
    whole = F.floor(scaled)
    stepped = whole + F.when(scaled - whole >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return (
        F.when(~is_finite(x), F.lit(None).cast("double"))
        .when(F.abs(scaled) >= F.lit(_EXACT), x)
        .otherwise(stepped / scale)
    )


# A value is counted in steps of 2^-20 and, for what is left, of 2^-73.
_STEP, _REST = float(2**20), float(2**53)


def exact_mean(x: Column) -> Column:
    """The average as an aggregate that does not depend on the order in which rows and partial sums meet.

    Each value is split into whole numbers, these are added up exactly, and the one rounding is that
    of the final division. Null without values; NaN, infinity and values from 2^70 on are averaged as
    they are.
    """
    fits = F.abs(x) < F.lit(float(2**70))  # also false for NaN
    scaled = F.when(fits, x) * F.lit(_STEP)
    rest = scaled % F.lit(1.0)
    steps = F.sum((scaled - rest).cast("decimal(28,0)")).cast("double")
    rests = F.sum((rest * F.lit(_REST)).cast("bigint").cast("decimal(16,0)")).cast("double")
    return F.when(F.count(x) == F.count(F.when(fits, x)), (steps + rests / F.lit(_REST)) / F.lit(_STEP) / F.count(x)).otherwise(F.avg(x))


def temperature(x: Column, unit: str) -> Column:
    """Published temperature: two decimals in the requested unit."""
    return half_up(c_to_f(x) if unit == "f" else x, 2)


def rate(x: Column, unit: str) -> Column:
    """Published rate per minute: three decimals in the requested unit."""
    return half_up(c_rate_to_f(x) if unit == "f" else x, 3)


def requested_unit(name: str | None) -> str:
    return "c" if (name or "").lower() == "c" else "f"


def fixed(x: Column, digits: int = 1) -> Column:
    """Text with no or one decimal, a dash for null and non-finite values.

    The exact binary value is rounded, so 0.15 (stored slightly below) gives 0.1 while 0.25 gives
    0.3.  Ten times x is 8x + 2x, both exact, and the error of their sum is known: it settles the
    cases in which the rounded sum falls on a half.
    """
    if digits not in (0, 1):
        raise ValueError("fixed() formats with no or one decimal")
    size = F.abs(x)
    if digits == 0:
        scaled, error = size, F.lit(0.0)
    else:
        scaled = size * 8 + size * 2
        error = size * 2 - (scaled - size * 8)
    whole = F.floor(scaled)
    rest = scaled - whole
    steps = whole + F.when((rest > 0.5) | ((rest == 0.5) & (error >= 0)), 1).otherwise(0)
    digits_text = steps.cast("string") if digits == 0 else F.concat(
        F.floor(steps / 10).cast("string"), F.lit("."), (steps % 10).cast("string"))
    text = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), digits_text)
    return F.when(is_finite(x), text).otherwise(F.lit(MISSING))
