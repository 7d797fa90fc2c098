"""From JSON messages to readings: outcome, reason and the flat reading of every message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import RuntimeConfig
from emberline.functions import envelope as E
from emberline.functions.moments import epoch_ms
from emberline.schema import NORMALIZED

# Reasons reported for messages that give no reading.
NO_MESSAGE = "No application uplink was present"
NO_UPLINK = "No uplink message was present"
NO_PAYLOAD = "Uplink had no decoded payload"
NO_TEMPERATURE = "Uplink contained no temperature readings"
BAD_TIME = "Uplink has no valid received_at timestamp"
NO_IDENTITY = "Uplink is missing its application or device identifier"
OTHER_APPLICATION = "Unexpected application"
OTHER_DEVICE = "Unexpected device"


def message_fields(df: DataFrame, message: Column, cfg: RuntimeConfig) -> DataFrame:
    """Add the parsed fields of one message as ``_``-prefixed columns, opening each level once."""
    df = df.withColumn("_up", E.opened(
        message, "end_device_ids", "uplink_message", "correlation_ids", "received_at"))
    df = df.withColumns({
        "_ids": E.opened(F.col("_up.end_device_ids"), "application_ids", "device_id", "dev_eui"),
        "_link": E.opened(F.col("_up.uplink_message"), "session_key_id", "f_port", "f_cnt",
                          "decoded_payload", "rx_metadata"),
    })
    df = df.withColumns({
        "_decoded": E.opened(F.col("_link.decoded_payload"), "Temp_Channel1", "Temp_Channel2", "BatV"),
        "_received_at": E.nonempty_text(F.col("_up.received_at")),
        "_application_id": E.nonempty_text(
            E.opened(F.col("_ids.application_ids"), "application_id").application_id),
        "_device_id": E.nonempty_text(F.col("_ids.device_id")),
        "_dev_eui": E.hex_identity(E.text(F.col("_ids.dev_eui"))),
        "_session_key_id": E.nonempty_text(F.col("_link.session_key_id")),
        "_reception": E.strongest_reception(F.col("_link.rx_metadata")),
    })
    df = df.withColumn("_numbers", E.finite_numbers(
        F.col("_link.f_port"), F.col("_link.f_cnt"), *[F.col(f"_decoded.{name}") for name in ("Temp_Channel1", "Temp_Channel2", "BatV")]))
    df = df.withColumns({
        "_f_port": E.whole(F.col("_numbers")[0]),
        "_frame_counter": E.whole(F.col("_numbers")[1]),
        "_channel_1": F.col("_numbers")[2],
        "_channel_2": F.col("_numbers")[3],
        "_battery": F.col("_numbers")[4],
    })
    df = df.withColumns({
        "_observed_at_ms": epoch_ms(F.col("_received_at")),
        "_key": E.message_key(
            E.uplink_id(F.col("_up.correlation_ids")), F.col("_dev_eui"), F.col("_device_id"),
            F.col("_session_key_id"), F.col("_frame_counter"), F.col("_received_at")),
    })
    return df


def verdict(message: Column) -> Column:
    """Struct (outcome, reason): the first rule that applies decides."""
    def because(outcome: str, reason: str) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))

    return (
        F.when(message.isNull(), because("ignored", NO_MESSAGE))
        .when(F.col("_ids").isNull() | F.col("_link").isNull(), because("ignored", NO_UPLINK))
        .when(F.col("_decoded").isNull(), because("ignored", NO_PAYLOAD))
        .when(F.col("_channel_1").isNull() & F.col("_channel_2").isNull(),
              because("ignored", NO_TEMPERATURE))
        .when(F.col("_observed_at_ms").isNull(), because("error", BAD_TIME))
        .when(F.col("_application_id").isNull() | F.col("_device_id").isNull(),
              because("error", NO_IDENTITY))
        .otherwise(F.struct(F.lit("reading").alias("outcome"),
                            F.lit(None).cast("string").alias("reason")))
    )


def reading_columns(cfg: RuntimeConfig) -> dict[str, Column]:
    """The flat reading, once ``message_fields`` has added the parsed fields."""
    channels = {1: F.col("_channel_1"), 2: F.col("_channel_2")}
    return {
        "message_key": F.col("_key"),
        "observed_at_ms": F.col("_observed_at_ms"),
        "received_at": F.col("_received_at"),
        "application_id": F.col("_application_id"),
        "device_id": F.col("_device_id"),
        "dev_eui": F.col("_dev_eui"),
        "session_key_id": F.col("_session_key_id"),
        "f_port": F.col("_f_port"),
        "frame_counter": F.col("_frame_counter"),
        "temp_channel_1_c": channels[1],
        "temp_channel_2_c": channels[2],
        "sauna_temp_c": channels[cfg.air_channel],
        "stovepipe_temp_c": channels[cfg.heater_channel],
        "battery_v": F.col("_battery"),
        "rssi_dbm": F.col("_reception.rssi"),
        "snr_db": F.col("_reception.snr"),
    }


def normalize_uplinks(df: DataFrame, cfg: RuntimeConfig, body: str = "body") -> DataFrame:
    """Parse a column of JSON bodies (VARIANT): ``outcome``, ``reason`` and ``reading``.

    ``received_at`` is the authoritative time, the device's own clock is not read.  All other
    columns are passed through.  Works on streams as well: it is a projection.
    """
    keep = df.columns
    df = df.select(*keep, E.evaluated(E.chosen_message(F.col(body))).alias("_message"))
    df = message_fields(df, F.col("_message"), cfg)
    df = df.withColumn("_verdict", verdict(F.col("_message")))
    reading = F.struct(*[value.alias(name) for name, value in reading_columns(cfg).items()])
    parsed = F.struct(
        F.col("_verdict.outcome").alias("outcome"), F.col("_verdict.reason").alias("reason"),
        F.when(F.col("_verdict.outcome") == "reading", reading).alias("reading"))
    return df.select(*keep, E.evaluated(parsed).alias("_parsed")).select(*keep, "_parsed.*")


def expect_source(parsed: DataFrame, cfg: RuntimeConfig) -> DataFrame:
    """Turn readings of another application or device into errors, where the settings name one."""
    wrong = F.lit(None).cast("string")
    if cfg.dev_eui:
        wrong = F.when(~F.col("reading.dev_eui").eqNullSafe(F.lit(cfg.dev_eui)), OTHER_DEVICE)
    if cfg.application_id:
        wrong = F.when(F.col("reading.application_id") != cfg.application_id,
                       OTHER_APPLICATION).otherwise(wrong)
    wrong = F.when(F.col("outcome") == "reading", wrong)
    return parsed.withColumn("_wrong", wrong).withColumns({
        "outcome": F.when(F.col("_wrong").isNotNull(), F.lit("error")).otherwise(F.col("outcome")),
        "reason": F.coalesce("_wrong", "reason"),
        "reading": F.when(F.col("_wrong").isNull(), F.col("reading")),
    }).drop("_wrong")


def readings_of(parsed: DataFrame, *extra: str) -> DataFrame:
    """The readings of a parsed frame as flat columns, with the named other columns kept."""
    return parsed.where("outcome = 'reading'").select(
        *[F.col(f"reading.{name}").alias(name) for name in NORMALIZED.names], *extra)


def quarantined(parsed: DataFrame) -> DataFrame:
    """Messages that gave no reading, with the reason."""
    return parsed.where("outcome <> 'reading'").drop("reading")
