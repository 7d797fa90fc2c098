"""Identity and duplicates: first writer wins, unseen keys, packet identity, counter reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The reading fields that make two messages with one key the same or a conflict.
SIGNATURE_FIELDS = (
    "observed_at_ms", "received_at", "application_id", "device_id", "dev_eui", "session_key_id",
    "f_port", "frame_counter", "temp_channel_1_c", "temp_channel_2_c", "sauna_temp_c",
    "stovepipe_temp_c", "battery_v", "rssi_dbm", "snr_db",
)


def dedupe_first(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The first row of each key in arrival order.

    Spark turns the rank filter into a group limit before the shuffle, so of a key with very many
    copies each task sends on one row.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def new_rows_only(batch: DataFrame, stored: DataFrame, key: str = "message_key") -> DataFrame:
    """Rows whose key is not stored yet."""
    return batch.join(stored.select(key), key, "left_anti")


def packet_sha256(eui: Column, device: Column, received_at: Column, counter: Column) -> Column:
    """Hash of the physical packet's identity, null without EUI or counter."""
    identity = F.concat_ws("\0", eui, device, received_at, counter.cast("string"))
    return F.when(eui.isNotNull() & counter.isNotNull(), F.sha2(identity, 256))


def reading_signature() -> Column:
    """Hash over all non-key fields of a reading; equal exactly when the fields are."""
    fields = [F.col(name) for name in SIGNATURE_FIELDS]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def frame_counter_reuse(readings: DataFrame) -> DataFrame:
    """Counters of a device seen with more than one ``received_at``.

    Reported only: counters restart, so reuse does not make two messages the same.
    """
    return (
        readings.where("dev_eui IS NOT NULL AND frame_counter IS NOT NULL")
        .groupBy("dev_eui", "device_id", "frame_counter")
        .agg(F.countDistinct("received_at").alias("timestamps"))
        .where("timestamps > 1")
    )


def latest_of(readings: DataFrame, by: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """The newest reading of each device, or of all when ``by`` is empty.

    The newest time per device is a hash aggregate over two columns with partial sums; only the
    rows at that time are then read in full, instead of sorting whole rows by device.
    """
    if not by:
        return readings.orderBy(F.desc("observed_at_ms"), F.desc("message_key")).limit(1)
    newest = readings.groupBy(*by).agg(F.max("observed_at_ms").alias("observed_at_ms"))
    tied = readings.join(newest, [*by, "observed_at_ms"], "left_semi")
    rest = [c for c in readings.columns if c not in by]
    return tied.groupBy(*by).agg(
        F.max_by(F.struct(*rest), F.struct("observed_at_ms", "message_key")).alias("_r")
    ).select(*by, "_r.*").select(*readings.columns)


def supersedes(held_ms: Column, incoming_ms: Column) -> Column:
    """Whether a display may go from the held observation time to the incoming one.

    Anything replaces nothing; null never replaces something; an older time never replaces a newer.
    """
    return held_ms.isNull() | F.coalesce(incoming_ms >= held_ms, F.lit(False))


def monotone_latest(held: DataFrame, incoming: DataFrame, key: str = "device_id") -> DataFrame:
    """Held state after taking in newer-or-equal incoming rows (both with ``observed_at_ms``)."""
    rows = (held.withColumn("_side", F.lit(0))
            .unionByName(incoming.where("observed_at_ms IS NOT NULL").withColumn("_side", F.lit(1))))
    rest = [c for c in held.columns if c != key]
    # Of incoming rows of one time the larger message key counts, so the order does not.
    newest = rows.groupBy(key).agg(F.max_by(
        F.struct(*rest), F.struct("observed_at_ms", "_side", "message_key")).alias("_r"))
    return newest.select(key, "_r.*").select(*held.columns)
