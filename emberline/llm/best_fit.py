"""Best-fit packing of documents into bins of bounded size, with conflicts.

A bin holds at most ``capacity`` words, at most one document of a source and at most one of a
duplicate cluster. Documents longer than a bin are cut into pieces of the capacity and a rest.

Items are dealt by a hash into shards of about ``SHARD_ROWS`` documents, whatever their source, so a
source that holds a third of all rows is a third of every shard. In a shard the items are placed in
decreasing size. Open bins are ordered by residual; every bin carries the bitmap of its sources and
clusters, and a tree over the residuals holds the intersection of the bitmaps below each node. The
successor search goes from the smallest residual that fits upwards, skips subtrees all of whose
bins conflict, and continues until the tightest compatible bin is found; only if there is none, a
new bin is opened.

Defined cases: items of null source conflict with no source; null and empty texts are items of
size 0; ties between bins go to the older bin, between items to the smaller doc_id; rows that repeat
a document are further items of its source and cluster, hence in other bins; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.dart_minhash import weight_fingerprint
from emberline.llm.words import by_bytes, find_words, light_batches

CAPACITY = 2048
SHARD_ROWS = 4096
_ALL = -1  # the intersection of no bitmaps


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.capacity = capacity
        self.common = [_ALL] * (2 * self.leaves)
        self.by_residual: dict[int, list[int]] = {}
        self.residual: list[int] = []
        self.bitmap: list[int] = []
        self.items: list[int] = []

    def _refresh(self, residual: int) -> None:
        node = residual + self.leaves
        common = _ALL
        for b in self.by_residual.get(residual, ()):
            common &= self.bitmap[b]
        while node:
            if self.common[node] == common and node < self.leaves:
                return
            self.common[node] = common
            node >>= 1
            if node:
                common = self.common[2 * node] & self.common[2 * node + 1]

    def _tightest(self, size: int, bits: int) -> int | None:
        """The compatible bin of the smallest residual of ``size`` or more."""
        stack = [(1, 0, self.leaves)]
        while stack:
            node, low, width = stack.pop()
            if low + width <= size or self.common[node] & bits:
                continue
            if width > 1:
                half = width // 2
                stack.append((2 * node + 1, low + half, half))
                stack.append((2 * node, low, half))
                continue
            for b in self.by_residual.get(low, ()):
                if not self.bitmap[b] & bits:
                    return b
        return None

    def place(self, size: int, bits: int) -> tuple[int, int]:
        """Put an item into its bin: (bin, position in it)."""
        b = self._tightest(size, bits)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.bitmap.append(0)
            self.items.append(0)
        else:
            self.by_residual[self.residual[b]].remove(b)
            self._refresh(self.residual[b])
        self.residual[b] -= size
        self.bitmap[b] |= bits
        place = self.by_residual.setdefault(self.residual[b], [])
        place.append(b)
        place.sort()
        self._refresh(self.residual[b])
        self.items[b] += 1
        return b, self.items[b] - 1


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, cluster) per document; equal word sequences are one cluster."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = find_words(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.per_doc),
                 pa.array(weight_fingerprint(words).view(np.int64))],
                names=["doc_id", "source", "n_words", "cluster"])

    return light_batches(docs).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        measure, "doc_id long, source string, n_words long, cluster long")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: doc_id, piece, first_word, n_words, shard, bin_id, position.

    ``items`` has doc_id, source, n_words and cluster (0: without words, in no cluster). ``bin_id``
    is unique over all shards; pieces of a bin are in the order of ``position``.
    """
    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_words", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        pieces = np.maximum(1, -(-shard.n_words.to_numpy() // capacity))
        row = np.repeat(np.arange(len(shard)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, shard.n_words.to_numpy()[row] - piece * capacity)
        order = np.lexsort((piece, row, -size))
        row, piece, size = row[order], piece[order], size[order]
        # One bit for each source, and for each cluster of several items.
        source, names = pd.factorize(shard.source)
        cluster = shard.cluster.to_numpy()[row]
        shared, count = np.unique(cluster, return_counts=True)
        shared = shared[(count > 1) & (shared != 0)].tolist()
        bit_of = {c: 1 << (len(names) + i) for i, c in enumerate(shared)}
        bins = Bins(capacity)
        placed = [
            bins.place(n, (1 << s if s >= 0 else 0) | bit_of.get(c, 0))
            for n, s, c in zip(size.tolist(), source[row].tolist(), cluster.tolist())]
        number = shard["shard"].iloc[0]
        return pd.DataFrame({
            "doc_id": shard.doc_id.to_numpy()[row], "piece": piece, "first_word": piece * capacity, "n_words": size,
            "shard": number, "bin_id": [int(number) << 32 | b for b, _ in placed], "position": [p for _, p in placed]})

    shards = max(1, -(-items.count() // shard_rows))
    dealt = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("n_words").cast("long"), F.lit(0)).alias("n_words"),
        F.coalesce(F.col("cluster").cast("long"), F.lit(0)).alias("cluster"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_words", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        fill, "doc_id long, piece long, first_word long, n_words long, shard long, bin_id long, position long")
