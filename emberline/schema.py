"""Table schemas and the data-quality rules that stand in for table constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _fields(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in specs])


_L, _S, _D, _I = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()

# One normalised message, without the values derived from its neighbours.
NORMALIZED = _fields(
    ("message_key", _S, False), ("observed_at_ms", _L, False), ("received_at", _S, False),
    ("application_id", _S, False), ("device_id", _S, False), ("dev_eui", _S, True),
    ("session_key_id", _S, True), ("f_port", _L, True), ("frame_counter", _L, True),
    ("temp_channel_1_c", _D, True), ("temp_channel_2_c", _D, True),
    ("sauna_temp_c", _D, True), ("stovepipe_temp_c", _D, True),
    ("battery_v", _D, True), ("rssi_dbm", _D, True), ("snr_db", _D, True),
)

READINGS = _fields(
    ("message_key", _S, False), ("observed_at_ms", _L, False), ("received_at", _S, False),
    ("inserted_at_ms", _L, False), ("application_id", _S, False), ("device_id", _S, False),
    ("dev_eui", _S, True), ("session_key_id", _S, True), ("f_port", _L, True),
    ("frame_counter", _L, True), ("temp_channel_1_c", _D, True), ("temp_channel_2_c", _D, True),
    ("sauna_temp_c", _D, True), ("stovepipe_temp_c", _D, True),
    ("sauna_rate_c_per_min", _D, True), ("stovepipe_rate_c_per_min", _D, True),
    ("battery_v", _D, True), ("rssi_dbm", _D, True), ("snr_db", _D, True),
)

SESSIONS = _fields(
    ("device_id", _S, False), ("started_at_ms", _L, False), ("ended_at_ms", _L, True),
    ("last_hot_at_ms", _L, False), ("peak_sauna_c", _D, True), ("peak_stovepipe_c", _D, True),
    ("max_stovepipe_rate_c_per_min", _D, True), ("sample_count", _L, False),
    ("complete", _I, False),
)

BASELINE = _fields(
    ("message_key", _S, True), ("application_id", _S, True), ("device_id", _S, True),
    ("dev_eui", _S, True), ("received_at", _S, True), ("frame_counter", _L, True),
    ("temp_channel_1_c", _D, True), ("temp_channel_2_c", _D, True),
)


def repeated_keys(readings: DataFrame) -> DataFrame:
    """Message keys stored more than once (a readings table must have none)."""
    return readings.groupBy("message_key").agg(F.count("*").alias("copies")).where("copies > 1")


def devices_with_two_open_sessions(sessions: DataFrame) -> DataFrame:
    """Devices with more than one open session (a sessions table must have none)."""
    return (
        sessions.where("ended_at_ms IS NULL")
        .groupBy("device_id").agg(F.count("*").alias("open_sessions")).where("open_sessions > 1")
    )
