"""Words of Arrow text batches as numpy arrays, without a Python object per word.

A word is a maximal run of digits, a-z (A-Z are lower-cased) and characters beyond ASCII, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. On UTF-8 this is a property of
single bytes, so it is found by table look-up over the whole buffer. Words carry a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_MULTIPLIER))


def _lowered() -> np.ndarray:
    """Byte to lower-cased byte, 0 where the byte is no part of a word."""
    table = np.zeros(256, np.uint8)
    for low, high, shift in ((0x30, 0x3A, 0), (0x61, 0x7B, 0), (0x41, 0x5B, 32), (0x80, 0x100, 0)):
        table[low:high] = np.arange(low, high) + shift
    return table


WORD_BYTES = _lowered()
SPACED_BYTES = np.arange(256, dtype=np.uint8)
SPACED_BYTES[0x41:0x5B] += 32
SPACED_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
# A NUL is a token character there; it takes the place of a byte that UTF-8 never has.
SPACED_BYTES[0] = 0xFF


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[begin:end] for each pair of positions, equal for equal sequences."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[:-1], dtype=U64, out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U64))


@dataclass
class Words:
    """Words of a slice of documents: byte span, hash, and the first word of each document."""
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one entry per document and the total at the end

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_doc)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, table: np.ndarray = WORD_BYTES) -> Words:
    data, offsets = text_bytes(column)
    low = table[data]
    inside = np.zeros(len(low) + 1, bool)
    np.not_equal(low, 0, out=inside[:-1])
    opens, closes = inside.copy(), np.zeros_like(inside)
    opens[1:] &= ~inside[:-1]
    closes[1:] = inside[:-1] & ~inside[1:]
    # A document's end also ends a word, its start begins one.
    cut = offsets[(offsets > 0) & (offsets < len(low))]
    cut = cut[inside[cut] & inside[cut - 1]]
    opens[cut] = closes[cut] = True
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
    first = np.searchsorted(begin, offsets)
    return Words(begin, end, spans_hash(_BYTE_VALUE[low], begin, end), first)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text; one longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def unused(name: str, frame: DataFrame) -> str:
    """``name``, or a longer one if ``frame`` has such a column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def light_batches(texts: DataFrame) -> DataFrame:
    """``texts``, which from now on reach Python in batches of bounded bytes, as texts can be long."""
    conf = texts.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return texts
