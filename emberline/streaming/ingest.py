"""Continuous ingest and incremental views of a message or readings stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberline.config import RuntimeConfig
from emberline.functions.numeric import exact_mean
from emberline.operators.history import SERIES
from emberline.operators.normalize import expect_source, normalize_uplinks
from emberline.schema import NORMALIZED
from emberline.sources.sinks import EVENT_DATE, path_exists
from emberline.streaming.devices import NAMES, device_stream, late_rates
from emberline.streaming.keys import BUCKETS, first_of_key

READING, QUARANTINE = "reading", "quarantine"
PROBLEM = "value string, reason string"


def _judged(messages: DataFrame, cfg: RuntimeConfig) -> DataFrame:
    """Texts only, for the stateful steps: message_key, arrival and payload.

    The payload is the reading as JSON or, without a key, the message and why it gave no reading.
    """
    parsed = expect_source(normalize_uplinks(messages, cfg), cfg)
    problem = F.struct("value", F.coalesce("problem", "reason").alias("reason"))
    return parsed.select(
        F.col("reading.message_key").alias("message_key"), "arrival",
        F.when(F.col("outcome") == "reading", F.to_json("reading")).otherwise(F.to_json(problem)).alias("payload"))


def _is_reading() -> Column:
    return F.col("message_key").isNotNull()


def _opened(rows: DataFrame, *extra: str) -> DataFrame:
    """The flat rows of judged messages: readings by date, the rest with the reason."""
    reading = F.from_json("payload", NORMALIZED)
    problem = F.when(~_is_reading(), F.from_json("payload", PROBLEM))
    opened = rows.select("*", F.when(_is_reading(), reading).alias("_r"), problem.alias("_p"))
    return opened.select(
        *[F.col(f"_r.{name}").alias(name) for name in NORMALIZED.names], "arrival", *extra, "_p.value", "_p.reason",
        F.when(_is_reading(), READING).otherwise(QUARANTINE).alias("kind"),
        F.timestamp_millis("_r.observed_at_ms").cast("date").alias(EVENT_DATE))


def _write(rows: DataFrame, path: str) -> None:
    """Overwrite what an interrupted try of the batch may have left."""
    rows.sortWithinPartitions("kind", EVENT_DATE, "device_id", "observed_at_ms").write.mode("overwrite").partitionBy(
        "kind", EVENT_DATE).parquet(path)


def ingest(messages: DataFrame, cfg: RuntimeConfig, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Parse messages, store each reading once for ever, keep the rest with the reason.

    The keys seen so far are state of the stream, not looked up in the stored table. Each micro-batch
    writes one folder, anew if it is retried.
    """
    firsts = first_of_key(_judged(messages, cfg), buckets=buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        _write(_opened(batch), f"{path}/batch={batch_id}")

    return firsts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def pipeline(messages: DataFrame, cfg: RuntimeConfig, path: str, late_path: str, checkpoint: str,
             buckets: int = BUCKETS) -> DataStreamWriter:
    """From messages to rates and sessions: parse, store new readings, and derive from them on insert.

    One query with two stateful steps, by message key and by device: a repeated message derives
    nothing. A micro-batch is written once, to a folder of its own; a retried one writes the same.
    Readings too late for the device's state get their rates from the folders written so far.
    """
    firsts = first_of_key(_judged(messages, cfg), buckets=buckets)
    reading = F.from_json("payload", NORMALIZED)
    # Rows without a reading have no device; they are dealt out instead of being one group.
    lane = F.concat(F.lit("\0"), F.pmod(F.xxhash64("arrival"), F.lit(buckets)).cast("string"))
    opened = firsts.select("*", reading.alias("_r")).select(
        "message_key", "arrival", "payload", F.coalesce("_r.device_id", lane).alias("device_id"), "_r.observed_at_ms",
        "_r.sauna_temp_c", "_r.stovepipe_temp_c")
    derived = NAMES[5:]

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, own = _opened(batch, *derived), f"{path}/batch={batch_id}"
        _write(rows, own)
        # The batch's own folder only; what is stored is listed and read if there is a late reading.
        fresh = spark.read.schema(rows.schema).parquet(own).where(F.col("kind") == READING).drop("kind", "value", "reason").withColumn(
            "batch", F.lit(batch_id))
        late = fresh.where("late")
        reach = late.agg(F.min("observed_at_ms").alias("low"), F.max("observed_at_ms").alias("high")).first()
        if reach.low is None:
            return
        # Only the dates and row groups in reach of the late readings are read, and of earlier batches no arrival.
        low = reach.low - cfg.window_ms
        columns = ["device_id", "observed_at_ms", "batch", "arrival", "sauna_temp_c", "stovepipe_temp_c"]
        earlier = stored_rows(spark, path).where(F.col("batch") < batch_id).where(
            (F.col(EVENT_DATE) >= F.timestamp_millis(F.lit(low)).cast("date")) & (
                F.col(EVENT_DATE) <= F.timestamp_millis(F.lit(reach.high)).cast("date"))).withColumn(
            "arrival", F.lit(None).cast("string"))
        near = earlier.select(*columns).unionByName(fresh.select(*columns)).where(F.col("observed_at_ms").between(low, reach.high))
        late_rates(late, near, cfg).drop("batch").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")

    return device_stream(opened, cfg, lanes=buckets).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The readings of all batches, as they were derived on insert."""
    return spark.read.parquet(path).where(F.col("kind") == READING).drop("kind", "value", "reason")


def quarantined_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("kind") == QUARANTINE).select("value", "reason", "arrival", "batch")


def derived_rows(spark: SparkSession, path: str, late_path: str) -> DataFrame:
    """All readings with their rates; those of late ones come from the late folder."""
    rows = stored_rows(spark, path)
    if not path_exists(spark, late_path):
        return rows
    return rows.where(~F.col("late")).unionByName(spark.read.parquet(late_path).select(*rows.columns))


def downsample_stream(readings: DataFrame, bucket_ms: int) -> DataFrame:
    """Tumbling epoch buckets of a readings stream, in update mode.

    There is no watermark, so a reading changes its bucket however late it is; the state is one row
    of partial sums per bucket. Readings that carry rates also get their averages.
    """
    timed = readings.withColumn("_at", F.timestamp_millis("observed_at_ms"))
    aggregates = [
        function(F.col(f"{prefix}_temp_c")).alias(f"{prefix}_{name}_c")
        for prefix in SERIES.values() for name, function in (("avg", exact_mean), ("min", F.min), ("max", F.max))]
    aggregates += [exact_mean(F.col(rate)).alias(f"{prefix}_rate_avg_c_per_min") for prefix in SERIES.values()
                   if (rate := f"{prefix}_rate_c_per_min") in readings.columns]
    return (
        timed.groupBy(F.window("_at", f"{bucket_ms} milliseconds").alias("_w"))
        .agg(F.count("*").alias("readings"), *aggregates)
        .withColumn("bucket_ms", F.unix_millis("_w.start")).drop("_w")
    )


def latest_stream(readings: DataFrame) -> DataFrame:
    """The newest reading of each device so far: an older one that arrives later changes nothing.

    Of readings of one time the one with the larger message key is the newest, in any order.
    """
    rest = [c for c in readings.columns if c != "device_id"]
    return readings.where("observed_at_ms IS NOT NULL").groupBy("device_id").agg(
        F.max_by(F.struct(*rest), F.struct("observed_at_ms", "message_key")).alias("_r")).select("device_id", "_r.*")
