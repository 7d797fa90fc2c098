"""Benchmark passages in documents, found by an FM-index of each shard of documents.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII. A window is
``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Every occurrence of a window in a document marks its words; overlapping and adjacent marks
merge into removal spans.

Documents are never shuffled: a shard is a slice of a scan task's batch (2 MB of text, or one
longer document). A shard's index covers the stretches of consecutive benchmark words that are at
least as long as the shortest window; no occurrence can lie elsewhere. All windows are searched
backwards at once through wavelet ranks, and the occurrences located from sampled suffix positions.

Windows reach the tasks in slices of the benchmark of bounded size (``SLICE_BYTES`` of text, or one
longer item); a larger benchmark takes several passes over each shard.

Defined cases: null and empty texts have no words; items without words have no windows; items that
repeat an item_id count once; items with a null item_id mark words but are not listed; an empty
benchmark marks nothing; repeated documents give repeated rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.fm_index import FmIndex
from emberline.llm.words import by_bytes, find_words, light_batches, text_bytes, unused

WINDOW = 10
SLICE_BYTES = 8 << 20
SHARD_BYTES = 2 << 20


class Windows:
    """The distinct windows of some benchmark items, as symbol rows by length."""

    def __init__(self, items: list[str | None], texts: list[str | None], size: int):
        words = find_words(pa.array(texts, pa.string()))
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        symbol = symbol + 1
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, low, high in zip(items, words.first[:-1], words.first[1:]):
            length = min(size, high - low)
            for at in range(low, high - length + 1 if length else low):
                owners[tuple(symbol[at:at + length])].add(item)
        by_length = defaultdict(list)
        for window, who in owners.items():
            by_length[len(window)].append((window, sorted(x for x in who if x is not None)))
        self.by_length = {
            n: (np.array([w for w, _ in rows], np.int64), [who for _, who in rows]) for n, rows in by_length.items()}
        self.shortest = min(by_length, default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words of no window."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _stretches(symbol: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Index text (stretches of symbols, each ended by 0) and the word each symbol comes from."""
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    heads = first[first < len(symbol)]
    begins[heads] = known[heads]
    at = np.flatnonzero(known)
    run = np.cumsum(begins)[at] - 1
    length = np.bincount(run)
    long_enough = (length >= shortest)[run] if len(run) else np.zeros(0, bool)
    at, run = at[long_enough], run[long_enough]
    if not len(at):
        return np.zeros(0, np.int64), at
    number = np.zeros(len(at), np.int64)
    number[1:] = np.cumsum(run[1:] != run[:-1])
    text = np.zeros(len(at) + number[-1] + 1, np.int64)
    origin = np.zeros(len(text), np.int64)
    text[np.arange(len(at)) + number] = symbol[at]
    origin[np.arange(len(at)) + number] = at
    return text, origin


def _occurrences(words, windows: Windows) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """(first word, number of words, items) of every occurrence of a window in a shard."""
    nothing = np.zeros(0, np.int64)
    text, origin = _stretches(windows.symbols(words.hash), words.first, windows.shortest)
    if not len(text):
        return nothing, nothing, []
    index = FmIndex(text, len(windows.vocabulary))
    begins, lengths, items = [nothing], [nothing], []
    for length, (phrases, owners) in windows.by_length.items():
        which, at = index.search(phrases)
        begins.append(origin[at])
        lengths.append(np.full(len(at), length))
        items += [owners[i] for i in which]
    return np.concatenate(begins), np.concatenate(lengths), items


def _pass(windows: Windows, first_pass: bool, carried: tuple[str, str], finish=None):
    """A pass over a scan task's texts; ``finish`` turns the batch with all it found into the result."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=SHARD_BYTES):
            names = batch.schema.names
            words = find_words(batch.column(names.index("text")))
            begin, length, items = _occurrences(words, windows) if windows.shortest else ([], [], [])
            rows = batch.num_rows
            if first_pass:
                spans, owners = [None] * rows, [[] for _ in range(rows)]
            else:
                spans = batch.column(names.index(carried[0])).to_pylist()
                owners = batch.column(names.index(carried[1])).to_pylist()
            found = defaultdict(list)
            doc = np.searchsorted(words.first, begin, "right") - 1
            for i, d in enumerate(doc):
                found[d].append(i)
            for d, which in found.items():
                low = begin[which] - words.first[d]
                pairs = np.stack([low, low + length[which]], 1)
                if spans[d]:
                    pairs = np.concatenate([pairs, np.frombuffer(spans[d], np.int64).reshape(-1, 2)])
                spans[d] = merged(pairs).tobytes()
                owners[d] = sorted({*owners[d], *(x for i in which for x in items[i])})
            own = [k for k, n in enumerate(names) if n not in carried]
            if finish:
                pairs = [np.frombuffer(s, np.int64).reshape(-1, 2) if s else np.zeros((0, 2), np.int64) for s in spans]
                yield finish(batch.select(own), words, pairs, owners)
            else:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in own), pa.array(spans, pa.binary()), pa.array(owners, pa.list_(pa.string()))],
                    names=[*(names[k] for k in own), *carried])

    return scan


def merged(pairs: np.ndarray) -> np.ndarray:
    """Spans (begin, end) in order, overlapping and adjacent ones as one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)
    return np.stack([pairs[new, 0], reach[last]], 1).astype(np.int64)


def _searched(docs: DataFrame, benchmark: DataFrame, size: int, slice_bytes: int, finish, schema: T.StructType) -> DataFrame:
    """The batches that ``finish`` makes of ``docs`` and what was found in them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_bytes))
    carried = (unused("bench_spans", docs), unused("bench_items", docs))
    between = T.StructType([*docs.schema.fields, T.StructField(carried[0], T.BinaryType()),
                            T.StructField(carried[1], T.ArrayType(T.StringType()))])
    docs = light_batches(docs)
    for part in range(slices):
        # At most about slice_bytes of benchmark text on the driver and in a task at a time.
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == part).collect()
        windows = Windows([r.item for r in rows], [r.text for r in rows], size)
        last = part == slices - 1
        docs = docs.mapInArrow(_pass(windows, part == 0, carried, finish if last else None), schema if last else between)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted as strings), spans of words (begin, end)."""
    def report(batch: pa.RecordBatch, words, pairs: list[np.ndarray], owners: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.per_doc), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in pairs], pa.int64()),
             pa.array(owners, pa.list_(pa.string())), pa.array([s.tolist() for s in pairs], pa.list_(pa.list_(pa.int64())))],
            names=["doc_id", "n_words", "n_hit", "items", "spans"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _searched(texts, benchmark, size, slice_bytes, report, schema)


def remove_passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` without the benchmark's passages: their words are cut out of ``text``.

    What stands between two cut spans stays, joined by one space; documents all of whose words are
    cut go; all others, and documents without words, stay, with n_chars (where there is such a
    column) counted anew for changed texts.
    """
    at, hit = docs.columns.index("text"), unused("bench_hit", docs)

    def cut(batch: pa.RecordBatch, words, pairs: list[np.ndarray], owners: list[list[str]]) -> pa.RecordBatch:
        text, total = batch.column(at), words.per_doc
        gone = np.array([(s[:, 1] - s[:, 0]).sum() for s in pairs], np.int64)
        if gone.any():
            new = text.to_pylist()
            data, offsets = text_bytes(text)
            for i in np.flatnonzero(gone):
                base = words.first[i]
                edges = [offsets[i], *(x for b, e in pairs[i] for x in (words.begin[base + b], words.end[base + e - 1])),
                         offsets[i + 1]]
                parts = [data[a:b].tobytes().decode().strip() for a, b in zip(edges[::2], edges[1::2])]
                new[i] = " ".join(p for p in parts if p)
            text = pa.array(new, pa.string())
        columns = [text if k == at else c for k, c in enumerate(batch.columns)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(gone > 0)], names=[*batch.schema.names, hit])
        return out.filter(pa.array((gone == 0) | (gone < total)))

    schema = T.StructType([*docs.schema.fields, T.StructField(hit, T.BooleanType())])
    cleaned = _searched(docs, benchmark, size, slice_bytes, cut, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(
            F.col(hit), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
