"""Table constraints as data-quality checks: found as rows, and observed while a table is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from emberline.operators.rates import DEVICE
from emberline.operators.slices import TIME
from emberline.schema import devices_with_two_open_sessions, repeated_keys
from emberline.session import cut_lineage

# Rule names, in the order of the table constraints they stand for.
ONE_KEY, ONE_OPEN_SESSION, KNOWN_READING = "one_reading_per_key", "one_open_session", "session_refers_to_readings"
RULES = (ONE_KEY, ONE_OPEN_SESSION, KNOWN_READING)


class ConstraintError(ValueError):
    """A table that breaks its constraints was about to be published."""


def sessions_without_readings(sessions: DataFrame, readings: DataFrame) -> DataFrame:
    """Times a session names (start, last hot reading, end) at which its device has no reading."""
    named = sessions.select(DEVICE, "started_at_ms", F.explode(F.array_distinct(F.array_compact(
        F.array("started_at_ms", "last_hot_at_ms", "ended_at_ms")))).alias(TIME))
    return named.join(readings.select(DEVICE, TIME), [DEVICE, TIME], "left_anti")


def violations(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    """rule, subject, times: what breaks a rule, and how often; no rows for sound tables."""
    keys = repeated_keys(readings).select(F.lit(ONE_KEY).alias("rule"), F.col("message_key").alias("subject"), F.col("copies").alias("times"))
    several = devices_with_two_open_sessions(sessions).select(
        F.lit(ONE_OPEN_SESSION).alias("rule"), F.col(DEVICE).alias("subject"), F.col("open_sessions").alias("times"))
    missing = sessions_without_readings(sessions, readings).groupBy(DEVICE, "started_at_ms").agg(F.count("*").alias("times")).select(
        F.lit(KNOWN_READING).alias("rule"), F.concat_ws("@", DEVICE, F.col("started_at_ms").cast("string")).alias("subject"), "times")
    return keys.unionByName(several).unionByName(missing)


def write_checked(readings: DataFrame, sessions: DataFrame, path: str) -> dict[str, int]:
    """Write both tables and their violations; returns how many of each rule, observed while writing.

    ``path/violations`` is written first and its rows are counted on the way; the tables follow only
    if there are none, so nobody reads tables that break a rule.
    """
    readings, sessions = cut_lineage(readings), cut_lineage(sessions)
    observed = Observation()
    violations(readings, sessions).observe(observed, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col("rule") == rule).alias(rule) for rule in RULES]).write.mode("overwrite").parquet(f"{path}/violations")
    found = {rule: observed.get[rule] for rule in RULES}
    if observed.get["rows"]:
        raise ConstraintError(", ".join(f"{rule}: {n}" for rule, n in found.items() if n))
    readings.write.mode("overwrite").parquet(f"{path}/readings")
    sessions.write.mode("overwrite").parquet(f"{path}/sessions")
    return found
