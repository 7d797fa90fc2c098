"""The telemetry table: readings, messages and archive pages derived from ``events``."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.config import RuntimeConfig
from emberline.functions.moments import iso_utc

APPLICATION = "field"

# ``events`` has a few rows per device and day, so intervals are scaled up with it.
CADENCE = RuntimeConfig(
    expected_interval_s=12 * 3_600, rate_window_min=36 * 60, rate_span_min=12 * 60,
    start_c=50, end_c=25, end_hold_min=12 * 60)
ARRIVAL = ("event_id",)
AS_OF_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z


def events(spark: SparkSession, sf_dir: str, from_ms: int | None = None,
           to_ms: int | None = None) -> DataFrame:
    """The raw table; time bounds are put on the stored column, where the scan can use them."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")

    def literal(ms: int) -> Column:
        moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)
        return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

    if from_ms is not None:
        df = df.where(F.col("ts") >= literal(from_ms))
    if to_ms is not None:
        df = df.where(F.col("ts") < literal(to_ms))
    return df


def for_all_cores(df: DataFrame) -> DataFrame:
    """Deal rows out before texts are made of them, which costs far more than moving the rows."""
    return df.repartition("event_id")


def as_readings(df: DataFrame, *keep: str) -> DataFrame:
    """Each event as a reading: ``value`` heats, the air probe is missing on errors."""
    key = F.get_json_object("props", "$.k").cast("bigint")
    time = F.unix_millis(F.col("ts").cast("timestamp"))
    return df.select(
        "event_id", *keep,
        F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("message_key"),
        time.alias("observed_at_ms"),
        iso_utc(time).alias("received_at"),
        F.lit(APPLICATION).alias("application_id"),
        F.col("user_id").cast("string").alias("device_id"),
        F.lpad(F.hex("user_id"), 16, "0").alias("dev_eui"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_key_id"),
        F.lit(2).cast("bigint").alias("f_port"),
        key.alias("frame_counter"),
        _air().alias("temp_channel_1_c"),
        F.col("value").alias("temp_channel_2_c"),
        _air().alias("sauna_temp_c"),
        F.col("value").alias("stovepipe_temp_c"),
        (F.lit(3.0) + key / 200).alias("battery_v"),
        (-50.0 - key).alias("rssi_dbm"),
        (key / 10).alias("snr_db"),
    )


def _air() -> Column:
    return F.when(F.col("event_type") != "error", 20 + F.col("value") / 2)


def readings(spark: SparkSession, sf_dir: str, from_ms: int | None = None,
             to_ms: int | None = None) -> DataFrame:
    return as_readings(events(spark, sf_dir, from_ms, to_ms))


def _message(payload: Column, correlation: Column, received_at: Column | None = None,
             counter: Column | None = None, device: Column | None = None,
             application: Column | None = None, receptions: Column | None = None) -> Column:
    """A device message as a struct; null fields are left out when it is turned into JSON."""
    key = F.get_json_object("props", "$.k").cast("bigint")
    time = F.unix_millis(F.col("ts").cast("timestamp"))
    return F.struct(
        F.struct(
            (F.col("user_id").cast("string") if device is None else device).alias("device_id"),
            F.struct((F.lit(APPLICATION) if application is None else application)
                     .alias("application_id")).alias("application_ids"),
            F.regexp_replace(F.lower(F.lpad(F.hex("user_id"), 16, "0")), "(..)(?=.)", "$1 ").alias("dev_eui"),
        ).alias("end_device_ids"),
        correlation.alias("correlation_ids"),
        (iso_utc(time) if received_at is None else received_at).alias("received_at"),
        F.struct(
            F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_key_id"),
            F.lit(2).alias("f_port"),
            (key if counter is None else counter).alias("f_cnt"),
            payload.alias("decoded_payload"),
            (F.lit(None).cast("array<struct<rssi:double>>") if receptions is None
             else receptions).alias("rx_metadata"),
        ).alias("uplink_message"),
    )


def messages(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Every event as a JSON message, in all the shapes a message may come in.

    ``value`` holds the text; ``keep`` names columns of the table to be kept.  Some messages carry no temperature, a bad time, no device or numbers
    spelled as strings; every 101st is cut short and is not JSON.
    """
    df = for_all_cores(events(spark, sf_dir))
    n = F.col("event_id")
    key = F.get_json_object("props", "$.k").cast("bigint")
    battery = (F.lit(3.0) + key / 200).alias("BatV")
    heater = F.col("value")
    spelled = F.when(n % 7 == 0, F.lit(True)).otherwise(F.lit(False))
    payload = F.when(n % 97 == 0, F.to_json(F.struct(battery))).when(
        spelled, F.to_json(F.struct(battery, _air().cast("string").alias("Temp_Channel1"),
                                    heater.cast("string").alias("Temp_Channel2")))
    ).otherwise(F.to_json(F.struct(battery, _air().alias("Temp_Channel1"),
                                   heater.alias("Temp_Channel2"))))
    correlation = (
        F.when(n % 3 == 0, F.array(F.lit("x:1"), F.concat(F.lit("gs:uplink:"), n.cast("string"))))
        .when(n % 3 == 1, F.array(F.concat(F.lit("as:up:"), n.cast("string")))))
    receptions = F.array(
        F.struct(F.lit(-90.0).alias("rssi"), F.lit(1.0).alias("snr")),
        F.struct((-50.0 - key).alias("rssi"), (key / 10).alias("snr")),
        F.struct((-50.0 - key).alias("rssi"), F.lit(99.0).alias("snr")))
    time = iso_utc(F.unix_millis(F.col("ts").cast("timestamp")))
    body = _message(
        F.lit("@payload@"), correlation,
        received_at=F.when(n % 89 == 0, F.lit("not-a-time")).otherwise(time),
        device=F.when(n % 83 != 0, F.col("user_id").cast("string")), receptions=receptions)
    # The payload's keys differ from row to row, which one struct cannot say.
    df = df.withColumn("_bare", F.replace(F.to_json(body), F.lit('"@payload@"'), payload))
    bare = F.col("_bare")
    status = F.lit('{"data":{"end_device_ids":{},"uplink_message":{"decoded_payload":{"BatV":3}}}}')
    shaped = (
        F.when(n % 5 == 0, bare)
        .when(n % 5 == 1, F.concat(F.lit('{"data":'), bare, F.lit("}")))
        .when(n % 5 == 2, F.concat(F.lit('{"result":'), bare, F.lit("}")))
        .when(n % 5 == 3, F.concat(F.lit("["), status, F.lit(',{"data":'), bare, F.lit("}]")))
        .otherwise(F.concat(F.lit("[7,"), bare, F.lit("]")))
    )
    shaped = df.withColumn("_shaped", shaped)
    return shaped.select("event_id", *keep, F.when(n % 101 == 0, F.left("_shaped", F.lit(20)))
                         .otherwise(F.col("_shaped")).alias("value"))


# Arriving files: the table is sent in these parts, one after the other.
PARTS_MS = tuple(AS_OF_MS - days * 86_400_000 for days in (21, 14, 7))


# More rows of a task are several files, so that a micro-batch, a number of files, is bounded by rows.
FILE_ROWS = 100_000


def _part(time: Column) -> Column:
    """Which part of the table a time is in."""
    passed = [F.when(time >= F.lit(at), 1).otherwise(0) for at in PARTS_MS]
    return passed[0] + passed[1] + passed[2]


def files_per_part(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _send(df: DataFrame, folder: str, writer: str) -> None:
    """Append rows as files, each device's in one file, or in several that follow each other, and in time order."""
    ordered = df.repartition(files_per_part(df.sparkSession), "user_id").sortWithinPartitions("user_id", "ts").drop("user_id", "ts", "part")
    getattr(ordered.write.mode("append").option("maxRecordsPerFile", FILE_ROWS), writer)(folder)


def send_readings(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The readings as files that arrive part by part."""
    rows = as_readings(events(spark, sf_dir), "user_id", "ts").withColumn("part", _part(F.col("observed_at_ms")))
    for part in range(len(PARTS_MS) + 1):
        _send(rows.where(F.col("part") == part), folder, "parquet")


def send_messages(spark: SparkSession, sf_dir: str, folder: str, late: bool = False) -> None:
    """Messages as files that arrive part by part.

    Each message comes again, from another port, with the next part.  With ``late``, every tenth is
    held back and arrives after all others.
    """
    texts = messages(spark, sf_dir, "user_id", "ts").withColumn("part", _part(F.unix_millis(F.col("ts").cast("timestamp"))))
    held = (F.col("event_id") % 10 == 3) if late else F.lit(False)
    texts = texts.withColumn("part", F.when(held, len(PARTS_MS) + 2).otherwise(F.col("part"))).drop("event_id")
    again = texts.withColumns({"part": F.col("part") + 1, "value": F.replace("value", F.lit('"f_port":2'), F.lit('"f_port":3'))})
    for part in range(len(PARTS_MS) + (4 if late else 2)):
        _send(texts.unionByName(again).where(F.col("part") == part), folder, "text")


PAGE_LINES = 2_000


def _page_line(payload: Column, **parts: Column) -> Column:
    return F.to_json(F.struct(_message(payload, **parts).alias("result")))


def archive_lines(spark: SparkSession, sf_dir: str, flawed: bool) -> DataFrame:
    """Archive pages as lines: ``file_no, file, line_no, line``.

    Every event gives one line; every 40th a second line, in a later file, that repeats it.  With
    ``flawed``, some lines break one rule each and the repeats disagree with their original.
    Channel 1 is the heater here, channel 2 the air probe.
    """
    n = F.col("event_id")
    df = for_all_cores(events(spark, sf_dir))
    case = n % 40
    key = F.get_json_object("props", "$.k").cast("bigint")
    named = F.array(F.concat(F.lit("gs:uplink:"), n.cast("string")))
    other = F.array(F.concat(F.lit("as:up:"), n.cast("string")))
    temps = F.struct(F.col("value").alias("Temp_Channel1"), _air().alias("Temp_Channel2"))
    line = _page_line(temps, correlation=named)
    if flawed:
        line = (
            F.when(case == 10, _page_line(F.struct(F.lit(3.1).alias("BatV")), correlation=named))
            .when(case == 11, F.lit("{broken"))
            .when(case == 12, F.replace(line, F.lit('{"result":'), F.lit('{"data":')))
            .when(case == 13, _page_line(temps, correlation=named, application=F.lit("other")))
            .when(case == 14, _page_line(F.struct(F.lit("bad").alias("Temp_Channel1"),
                                                  F.lit(True).alias("Temp_Channel2")), correlation=named))
            .when(case == 15, _page_line(temps, correlation=named,
                                         received_at=F.lit("2030-01-01T00:00:00Z")))
            .when(case == 16, _page_line(F.struct(F.lit(2_000).alias("Temp_Channel1")), correlation=named))
            .when(case == 17, _page_line(temps, correlation=named, device=F.lit("")))
            .otherwise(line)
        )
    copy = line
    if flawed:
        changed = F.struct((F.col("value") + 1).alias("Temp_Channel1"), _air().alias("Temp_Channel2"))
        copy = (
            F.when(case == 1, _page_line(changed, correlation=named))
            .when(case == 2, _page_line(temps, correlation=other))
            .when(case == 3, _page_line(temps, correlation=other, counter=key + 100))
            .otherwise(line)
        )
    page = F.floor(n / PAGE_LINES)
    originals = df.select(page.alias("page"), n.alias("event_id"), F.lit(0).alias("again"), line.alias("line"))
    repeats = df.where(case <= (3 if flawed else 0)).select(
        page.alias("page"), n.alias("event_id"), F.lit(1).alias("again"), copy.alias("line"))
    return originals.unionByName(repeats).select(
        # All repeats come after all originals.
        (F.col("page") + F.col("again") * F.lit(1 << 40)).alias("file_no"),
        F.concat(F.when(F.col("again") == 1, "repeat-").otherwise("page-"),
                 F.col("page").cast("string"), F.lit(".ndjson")).alias("file"),
        (n % PAGE_LINES + 1).alias("line_no"), "line")


def live_rows(spark: SparkSession, sf_dir: str, flawed: bool) -> DataFrame:
    """The live baseline as ``row_no, row``: every fourth event is live already, under another key.

    With ``flawed``, some rows break a rule, repeat a key or an event, or disagree with the archive.
    """
    n = F.col("event_id")
    case = n % 40
    key = F.get_json_object("props", "$.k").cast("bigint")
    time = iso_utc(F.unix_millis(F.col("ts").cast("timestamp")))
    df = events(spark, sf_dir).where(n % 4 == 0)

    def row(live_key: Column, counter: Column, received_at: Column, heater: Column) -> Column:
        return F.struct(
            live_key.alias("message_key"), F.lit(APPLICATION).alias("application_id"),
            F.col("user_id").cast("string").alias("device_id"),
            F.lpad(F.hex("user_id"), 16, "0").alias("dev_eui"), received_at.alias("received_at"),
            counter.alias("frame_counter"), heater.alias("temp_channel_1_c"),
            _air().alias("temp_channel_2_c"))

    live_key = F.concat(F.lit("live:"), n.cast("string"))
    value = F.col("value")
    first = row(live_key, key, time, value)
    if flawed:
        first = (
            F.when(case == 4, row(live_key, key, time, value + 1))                         # other value
            .when(case == 8, row(F.concat(F.lit("gs:uplink:"), n.cast("string")), key + 100, time, value))
            .when(case == 20, row(F.lit(""), key, time, value))                            # no key
            .when(case == 24, row(live_key, key, F.lit("soon"), value))                    # no time
            .otherwise(first)
        )
    rows = [df.select((n * 2 + 1).alias("row_no"), first.alias("row"))]
    if flawed:
        again = df.where(case.isin(28, 32)).select((n * 2 + 2).alias("row_no"), F.when(
            case == 28, row(live_key, key + 100, time, value)).otherwise(
            row(F.concat(live_key, F.lit("b")), key, time, value)).alias("row"))
        rows.append(again)
    union = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return union.select("row_no", F.to_variant_object("row").alias("row"))
