"""Writers: insert-if-absent readings, audit manifest, replay set and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from emberline.operators.dedupe import dedupe_first, new_rows_only
from emberline.session import cut_lineage

EVENT_DATE = "event_date"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stored_readings(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def already_stored(fresh: DataFrame, stored: DataFrame, key: str = "message_key") -> DataFrame:
    """The keys of ``fresh`` that are stored.

    The stored table streams past the batch's keys: as long as these fit a broadcast (``fresh`` is a
    written table, so its size is known), nothing stored is shuffled, and only its key column is
    read. A larger batch, a bulk load, is joined by a shuffle of that one column.
    """
    return stored.select(key).join(fresh.select(key), key, "left_semi")


def insert_if_absent(batch: DataFrame, path: str, order: tuple[str, ...]) -> int:
    """Append readings whose key is not stored yet, the first of each key; returns how many.

    For batches; a stream keeps its keys in state (``streaming.keys``). Stored by event date and
    sorted by device and time within files, so time ranges prune folders and row groups.
    """
    fresh = cut_lineage(dedupe_first(batch, "message_key", order))
    stored = stored_readings(batch.sparkSession, path)
    if stored is not None:
        fresh = new_rows_only(fresh, already_stored(fresh, stored))
    counted = Observation()
    (
        fresh.observe(counted, F.count(F.lit(1)).alias("stored"))
        .withColumn(EVENT_DATE, F.timestamp_millis("observed_at_ms").cast("date"))
        .hint("rebalance", EVENT_DATE, "device_id")  # splits the partition of a busy device
        .sortWithinPartitions(EVENT_DATE, "device_id", "observed_at_ms")
        .write.mode("append").partitionBy(EVENT_DATE).parquet(path)
    )
    return counted.get["stored"]


POINTER = "current"


def _point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the published one: a small file, written aside and renamed over the old one."""
    hadoop = spark._jvm.org.apache.hadoop
    target, aside = hadoop.fs.Path(f"{folder}/{POINTER}"), hadoop.fs.Path(f"{folder}/.{POINTER}-{version}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, overwrite)


def published_version(spark: SparkSession, folder: str) -> str | None:
    """The version readers are to use, None before the first is published."""
    if not path_exists(spark, f"{folder}/{POINTER}"):
        return None
    return spark.read.text(f"{folder}/{POINTER}").first().value


def publish_audit(audit, folder: str) -> bool:
    """Write manifest and, after a clean audit, replay set as one new version, then switch to it.

    The manifest is the records, the source files and one row with validation block, summary and
    baseline coverage. Readers see the old version until all of the new one is there; an unclean
    audit's version has no replay set, which withdraws the one before. The lines of records and replay set
    are compressed (gzip), as there is one for each message. Returns whether there is a replay set.
    """
    spark = audit.records.sparkSession
    version = uuid.uuid4().hex
    path = f"{folder}/versions/{version}"
    audit.records.write.option("compression", "gzip").json(f"{path}/records")
    if audit.source_files is not None:
        audit.source_files.write.json(f"{path}/source_files")
    validation = F.struct(*[F.lit(value).alias(name) if not isinstance(value, dict) else F.struct(
        *[F.lit(v).alias(k) for k, v in value.items()]).alias(name) for name, value in audit.options.described().items()])
    # With its nulls, so that the manifest of an unclean audit has the same columns.
    audit.summary().withColumns({"schema_version": F.lit(1), "validation": validation}).write.option(
        "ignoreNullFields", "false").json(f"{path}/manifest")
    clean = spark.read.json(f"{path}/manifest").first().errors == 0
    if clean:
        replay = audit.entries.where("status = 'valid'").orderBy(*audit.replay_order())
        replay.select("envelope").write.option("compression", "gzip").text(f"{path}/replay")
    _point_to(spark, folder, version)
    return clean


def published(spark: SparkSession, folder: str, part: str) -> DataFrame | None:
    """A part of the published version: manifest, records, source_files or replay; None if it has none."""
    path = f"{folder}/versions/{published_version(spark, folder)}/{part}"
    if not path_exists(spark, path):
        return None
    return spark.read.text(path) if part == "replay" else spark.read.json(path)


def export_readings(readings: DataFrame, path: str, format: str = "parquet") -> None:
    """Full snapshot as parquet, json or csv."""
    writer = readings.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", "true")
    writer.format(format).save(path)


