"""Archive pages: NDJSON files with exact line numbers, and a content hash of each file.

Spark splits a large file into blocks and knows where each begins.  The line number is the number
of lines in the file's earlier blocks plus the position within the block, so a file of any size is
read in parallel and no file passes through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from emberline.session import cut_lineage

PATTERN = "*.ndjson"
BLANK = r"^[\s ﻿]*$"


def page_lines(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """Columns ``file_no, path, file, line_no, line``, one row per line, blank ones included.

    ``file_no`` ranks the files by path in language order (it has gaps).
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    raw = reader.text(folder).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    # A block is one read split, so its size is bounded by spark.sql.files.maxPartitionBytes.
    in_block = Window.partitionBy("path", "_block").orderBy("_seq")
    placed = raw.withColumn("_nth", F.row_number().over(in_block)).drop("_seq")

    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = raw.groupBy("path", "_block").agg(F.count("*").alias("_lines"))
    offsets = sizes.select("path", "_block", F.coalesce(
        F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    # Numbered by a range sort, not by one task, and stored: sampled ranges may differ next time.
    files = cut_lineage(offsets.select("path").distinct().orderBy(F.collate("path", "UNICODE"), "path")
                        .select("path", F.monotonically_increasing_id().alias("file_no")))
    return placed.join(offsets.join(files, "path"), ["path", "_block"]).select(
        "file_no", "path", "file", (F.col("_before") + F.col("_nth")).alias("line_no"), "line")


def is_blank(line: str = "line") -> Column:
    return F.col(line).rlike(BLANK)


# Bytes of a file that are hashed at a time.
CHUNK_BYTES = 1 << 18
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def chunks_of_lines(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, end: bytes = b"\n") -> Iterator[pa.RecordBatch]:
    """Lines of splits (path, block, bytes) put together, each with its end, into chunks of about ``size`` bytes."""
    held: list[bytes] = []
    place, at, length = None, 0, 0

    def chunk() -> pa.RecordBatch:
        path, block = place
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.binary())],
            names=["path", "block", "at", "bytes"])

    for batch in batches:
        for path, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and (place != (path, block) or length >= size):
                yield chunk()
                held, length, at = [], 0, at + 1
            place = (path, block)
            held += (line.as_buffer().to_pybytes(), end)
            length += len(held[-2]) + 1
    if held:
        yield chunk()


def running_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its chunks (path, file_size, ..., bytes), which come file by file and in order.

    Only the hash's state and one chunk are held. The last line's feed is left out where the file has
    none, and a byte order mark, which reading lines takes off, is put back: both show in the size.
    """
    path, size, seen, pending = None, 0, 0, b""
    tries: list = []

    def done() -> pa.RecordBatch:
        # The feed after the last line is the pending byte.
        extra = size - (seen - 1)
        digest = tries[extra >= 3]
        if extra in (1, 4):
            digest.update(pending)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "sha256"])

    for batch in batches:
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("path", "file_size", "bytes")}
        for name, length, content in zip(columns["path"].to_pylist(), columns["file_size"].to_pylist(), columns["bytes"], strict=True):
            if name != path:
                if path is not None:
                    yield done()
                path, size, seen, pending = name, length, 0, b""
                tries = [hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)]
            content = memoryview(content.as_buffer())
            for digest in tries:
                digest.update(pending)
                digest.update(content[:-1])
            pending = bytes(content[-1:])
            seen += len(content)
    if path is not None:
        yield done()


def file_hashes(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """Columns ``path, file, sha256`` of every file, whatever its size.

    A hash needs a file's bytes in order, so a file is one task at the end, but one that streams: the
    files are read in splits, in parallel, as lines of bytes that are put together into chunks, and
    the chunks of a file pass through a running hash in sorted order (Spark's sort spills).
    """
    def reader(kind: str):
        return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")

    # Without its content column the binary reader lists files of any size, but for empty ones; those
    # are in the names that Spark's own listing has.
    binary = reader("binaryFile").load(folder)
    sized = binary.select("path", F.col("length").alias("file_size"))
    path = F.regexp_replace("path", "^file:/+", "file:/")
    named = spark.createDataFrame([(name,) for name in binary.inputFiles()], "path string").select(
        path.alias("path"), F.url_decode(F.replace(F.regexp_extract("path", "[^/]*$", 0), F.lit("+"), F.lit("%2B"))).alias("file"))
    files = named.join(sized, "path", "left").select("path", "file", F.coalesce("file_size", F.lit(0)).alias("file_size"))
    pieces = reader("text").option("lineSep", "\n").load(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))
    chunks = pieces.mapInArrow(chunks_of_lines, "path string, block long, at long, bytes binary")
    listed = sized.select(F.col("path").alias("_path"), "file_size")
    ordered = chunks.join(listed, F.col("path") == F.col("_path")).select("path", "file_size", "block", "at", "bytes").repartition(
        "path").sortWithinPartitions("path", "block", "at")
    hashes = ordered.mapInArrow(running_hashes, "path string, sha256 string")
    nothing = F.when(F.col("file_size") == 0, F.lit(hashlib.sha256().hexdigest())).when(
        F.col("file_size") == len(BYTE_ORDER_MARK), F.lit(hashlib.sha256(BYTE_ORDER_MARK).hexdigest()))
    return files.join(hashes, "path", "left").select("path", "file", F.coalesce("sha256", nothing).alias("sha256"))


def source_file_summary(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """Columns ``path, file, sha256, json_lines, blank_lines``, one row per file."""
    lines = (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
        .select(F.col("_metadata.file_path").alias("path"), is_blank("value").alias("_blank"))
        .groupBy("path").agg(F.count_if(~F.col("_blank")).alias("json_lines"),
                             F.count_if("_blank").alias("blank_lines"))
    )
    return file_hashes(spark, folder, pattern).join(lines, "path", "left").select(
        "path", "file", "sha256", F.coalesce("json_lines", F.lit(0)).alias("json_lines"),
        F.coalesce("blank_lines", F.lit(0)).alias("blank_lines"))
