"""JSON device messages, one per line, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions.envelope import evaluated
from emberline.streaming.keys import in_arrival_order

# Fixed value: the largest message that is accepted by default, in bytes.
LARGEST_MESSAGE = 131_072

TOO_LARGE = "Message is too large"
NOT_JSON = "Message is not valid JSON"


def with_body(lines: DataFrame, column: str = "value", largest: int | None = LARGEST_MESSAGE) -> DataFrame:
    """Parse a text column: ``body`` (VARIANT) and, where there is none, the ``problem``.

    ``largest`` is a rule of the deployment, None accepts any size; what breaks it is quarantined.
    """
    raw = F.col(column)
    fits = F.lit(True) if largest is None else F.octet_length(raw) <= largest
    read = evaluated(F.struct(fits.alias("fits"), F.when(fits, F.try_parse_json(raw)).alias("body")))
    return lines.select("*", read.alias("_read")).select(
        *lines.columns, F.col("_read.body").alias("body"),
        F.when(~F.col("_read.fits"), TOO_LARGE).when(F.col("_read.body").isNull(), NOT_JSON)
        .alias("problem"))


def json_messages(spark: SparkSession, path: str, largest: int | None = LARGEST_MESSAGE) -> DataFrame:
    return with_body(spark.read.text(path), largest=largest)


def json_message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None,
                        largest: int | None = LARGEST_MESSAGE) -> DataFrame:
    """The same as a stream of newly arriving files, with ``arrival``, the order of the messages."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_body(in_arrival_order(reader.text(path)), largest=largest)


def parsable(messages: DataFrame) -> DataFrame:
    return messages.where("problem IS NULL").drop("problem")


def unparsable(messages: DataFrame) -> DataFrame:
    """The quarantine: raw text and why it could not be read."""
    return messages.where("problem IS NOT NULL").drop("body")
