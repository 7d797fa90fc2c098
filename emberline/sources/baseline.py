"""Live baseline: the rows an archive is reconciled against, as ``row_no`` and ``row`` (VARIANT)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.schema import BASELINE
from emberline.session import cut_lineage
from emberline.sources.pages import chunks_of_lines

WRONG_SHAPE = "Live baseline must be a JSON row array or have results arrays"
# A whole string, a mark of the structure, or the beginning of a string that goes on in the next chunk.
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{},:]|"', re.S)
ENTRY, INNER, END = "entry", "inner", "end"


class RowScanner:
    """Finds the rows of a JSON document that comes in chunks, holding one row and one chunk.

    Entries are what a top-level array holds, or the top-level object; inner rows are what the
    ``results`` arrays of entries hold. Which of the two are the document's rows shows at its end.
    """

    def __init__(self) -> None:
        self.buffer = ""
        self.open: list[str] = []
        self.base: int | None = None  # 1 below a top-level array, 0 for an object
        self.closed = self.wrong = False
        self.parts: dict[str, list[str]] = {ENTRY: [], INNER: []}
        self.kind: str | None = None  # of the item that is being read
        self.counts = {ENTRY: 0, INNER: 0}
        self.text = self.key = ""
        self.wrapped, self.all_wrapped = False, True

    def _take(self, start: int, end: int) -> None:
        if self.kind:
            self.parts[self.kind].append(self.buffer[start:end])

    def _finish(self, kind: str) -> tuple[str, int, str] | None:
        text = "".join(self.parts[kind]).strip()
        self.parts[kind] = []
        if kind == ENTRY:
            self.all_wrapped &= self.wrapped or not text
            self.wrapped = False
        if not text:
            return None
        self.counts[kind] += 1
        return kind, self.counts[kind], text

    def feed(self, chunk: str) -> Iterator[tuple[str, int, str]]:
        """(kind, number, text) of the items that end in the chunk."""
        self.buffer += chunk
        done = 0  # up to here the text belongs to items already
        at = 0
        for m in _TOKEN.finditer(self.buffer):
            token, at = m[0], m.end()
            if token == '"':
                at = m.start()
                break
            if self.closed:
                self.wrong |= self.buffer[done:at].strip() != "}"  # the end that the last line is given
                done = at
                continue
            if self.base is None:
                self.wrong |= bool(self.buffer[:m.start()].strip()) or token not in "[{"
                self.base, self.kind, done = int(token == "["), ENTRY, at if token == "[" else m.start()
                self.open = [token]
                continue
            found, depth = None, len(self.open)
            if token[0] == '"':
                self.text = token
            elif token == ":":
                self.key = self.text if depth == self.base + 1 and self.kind == ENTRY else self.key
            elif token == ",":
                level = {self.base: ENTRY, self.base + 2: INNER}.get(depth)
                if self.kind == level and (level == INNER or self.base):
                    self._take(done, m.start())
                    done, found = at, self._finish(level)
                self.key = "" if depth == self.base + 1 else self.key
            elif token in "[{":
                self.open.append(token)
                if token == "[" and self.kind == ENTRY and depth == self.base + 1 and self.key == '"results"':
                    self._take(done, at)
                    done, self.kind, self.wrapped = at, INNER, True
            else:
                self.wrong |= self.open.pop() + token not in ("[]", "{}")
                if self.kind == INNER and depth == self.base + 2:
                    self._take(done, m.start())
                    done, found, self.kind = m.start(), self._finish(INNER), ENTRY
                elif depth == 1:
                    self._take(done, at if self.base == 0 else m.start())
                    done, found, self.closed, self.kind = at, self._finish(ENTRY), True, None
            if found:
                yield found
        if self.closed or self.base is None:
            self.buffer = self.buffer[done if self.closed else 0:]
        else:
            self._take(done, at)
            self.buffer = self.buffer[at:]

    def shape(self) -> str | None:
        """The kind of the document's rows, None if it has none of the shapes."""
        if self.wrong or not self.closed or self.buffer.strip():
            return None
        if self.all_wrapped:
            return INNER
        return ENTRY if self.base else None


def scan_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, kind, row_no, text) of documents in chunks (path, ..., bytes) that come in order; at the end of each its shape."""
    path, scanner = None, RowScanner()

    def rows(items: list[tuple]) -> pa.RecordBatch:
        kinds, numbers, texts = zip(*items, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(items)), pa.array(kinds), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())],
            names=["path", "kind", "row_no", "text"])

    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
            if name != path:
                if path is not None:
                    yield rows([(END, 0, scanner.shape())])
                path, scanner = name, RowScanner()
            if items := list(scanner.feed(content.as_buffer().to_pybytes().decode("utf-8", "replace"))):
                yield rows(items)
    if path is not None:
        yield rows([(END, 0, scanner.shape())])


def baseline_document(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """A JSON document: an array of rows, or ``results`` arrays (one object or an array of them).

    ``path`` may be a folder of documents: rows are numbered within each, and ``keep`` names the
    partition columns that tell the documents apart. A document of any size is read in splits, as
    pieces that end with a closing brace; the pieces pass in order through a scanner that holds one
    row at a time, so a document is one task of bounded memory, and its rows are dealt out again.
    """
    pieces = spark.read.format("text").option("lineSep", "}").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    chunks = pieces.mapInArrow(lambda batches: chunks_of_lines(batches, end=b"}"), "path string, block long, at long, bytes binary")
    ordered = chunks.repartition("path").sortWithinPartitions("path", "block", "at")
    scanned = cut_lineage(ordered.mapInArrow(scan_documents, "path string, kind string, row_no long, text string"))
    wrong = F.raise_error(F.lit(WRONG_SHAPE)).cast("string")
    shapes = scanned.where(F.col("kind") == END).select(F.col("path").alias("_path"), F.coalesce("text", wrong).alias("_shape"))
    if keep:
        shapes = shapes.join(spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"), *keep), "_path")
    # The end of every document is looked at, also of one without rows.
    rows = scanned.join(shapes, F.col("path") == F.col("_path")).where(
        (F.col("kind") == F.col("_shape")) | ((F.col("kind") == END) & F.col("_shape").isNull()))
    return rows.select(*keep, "row_no", F.parse_json("text").alias("row"))


def baseline_table(readings: DataFrame, order: str) -> DataFrame:
    """A table with the baseline columns; ``order`` is a unique whole-number column that ranks rows."""
    row = F.to_variant_object(F.struct(*BASELINE.names))
    return readings.select(F.col(order).cast("bigint").alias("row_no"), row.alias("row"))
