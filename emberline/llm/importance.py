"""Importance resampling towards a target: draw the documents that look most like the target texts.

Features are all runs of one and two consecutive words (``words.find_words``), joined by one space;
a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. Two count arrays, of all
documents and of all target texts, give an array of whole-number gains, and a document's weight is
the floored mean gain of its features. Gumbel noise from a hash of the document's id is added to the
weight, so the highest scores are a weighted draw without replacement.

*Counts.* Each task adds up one array of ``BUCKETS`` numbers and hands on its buckets, which Spark
sums; the driver receives ``BUCKETS`` sums, whatever the corpus.

*Cutoff.* The scores of eligible documents are stored as sorted blocks of at most ``BLOCK`` keys.
Each round, a block's median weighs as much as the keys it still holds; the weighted median of a
task's blocks, and on the driver that of the tasks, is the next pivot (one row per task is sent).
At least an eighth of the remaining keys lies on either side of it, so each round discards that
much or ends, and the next round's medians, on both sides, come with the counts of this one. When
the stored keys are mostly discarded the rest is stored anew, so that all rounds together read the
keys a few times, not once per round. The end is the exact key of the last winner. Keys are unique:
the score, ties by smaller id, then by fewer features, then by row.

*Ranks.* Winners are range-partitioned by key and sorted; a rank is the position in the partition
plus the rows of earlier partitions.

Defined cases: null and empty texts have no words, weight 0 and take part in the draw only if
``least_words`` is 0; a null id counts as an empty one in the hash and comes after all others in
ties; every repeated row is a row of its own; rows equal in everything share their places in any
order; an empty table gives no rows; without target texts all gains are those of zero counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.words import WORD_BYTES, by_bytes, find_words, text_bytes
from emberline.session import cut_lineage

BUCKETS = 10_000
BLOCK = 1 << 16
# Words up to this length are hashed together, byte by byte; longer ones one at a time.
SHORT = 32
U32 = np.uint32


def _crc_step() -> np.ndarray:
    """CRC-32 of single bytes, from the polynomial."""
    table = np.arange(256, dtype=U32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ U32(0xEDB88320), table >> 1).astype(U32)
    return table


_STEP = _crc_step()


def _crc_shifts(most: int) -> np.ndarray:
    """[length, byte position, byte value]: what a checksum becomes when ``length`` bytes follow."""
    shifts = np.zeros((most + 1, 4, 256), U32)
    for place in range(4):
        shifts[0, place] = np.arange(256, dtype=U32) << U32(8 * place)
    for length in range(most):
        shifts[length + 1] = (shifts[length] >> U32(8)) ^ _STEP[shifts[length] & U32(255)]
    return shifts


_SHIFT = _crc_shifts(SHORT)
_SPACE = U32(zlib.crc32(b" "))


def _followed(crc: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    shift = _SHIFT[length] if isinstance(length, int) else None
    parts = [(crc >> U32(8 * place)) & U32(255) for place in range(4)]
    if shift is not None:
        out = [shift[place][part] for place, part in enumerate(parts)]
    else:
        out = [_SHIFT[length, place, part] for place, part in enumerate(parts)]
    return out[0] ^ out[1] ^ out[2] ^ out[3]


def word_checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[begin:end] for each pair, all words together, one byte a step."""
    length = end - begin
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -SHORT, "left"):]
    at, left = begin[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, U32)
    for k in range(int(left[0]) if len(left) else 0):
        alive = np.searchsorted(-left, -k, "left")  # words longer than k come first
        part = crc[:alive]
        crc[:alive] = _STEP[(part ^ data[at[:alive] + k]) & U32(255)] ^ (part >> U32(8))
    out = np.empty(len(begin), U32)
    out[order] = ~crc
    raw = data.tobytes() if (length > SHORT).any() else b""
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(raw[begin[i]:end[i]])
    return out


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the document (row) it is of, and the words of each document."""
    words = find_words(column)
    data = WORD_BYTES[text_bytes(column)[0]]
    one = word_checksums(data, words.begin, words.end)
    doc = words.doc()
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    length = words.end - words.begin
    second = pair + 1
    spaced = _followed(one[pair], 1) ^ _SPACE
    short = length[second] <= SHORT
    two = np.empty(len(pair), U32)
    two[short] = _followed(spaced[short], length[second[short]]) ^ one[second[short]]
    if not short.all():
        raw = data.tobytes()
        for i in np.flatnonzero(~short):
            a, b = pair[i], second[i]
            two[i] = zlib.crc32(raw[words.begin[a]:words.end[a]] + b" " + raw[words.begin[b]:words.end[b]])
    bucket = (np.concatenate([one, two]) % U32(buckets)).astype(np.int64)
    return bucket, np.concatenate([doc, doc[pair]]), words.per_doc


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches):
            sums += np.bincount(features(batch.column(0), buckets)[0], minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, for each bucket."""
    all_source, all_target, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            bucket, doc, n_words = features(batch.column(1), len(gain))
            n = np.bincount(doc, minlength=batch.num_rows)
            # Sums of whole numbers far below 2^53 are exact in floating point.
            total = np.bincount(doc, gain[bucket].astype(np.float64), batch.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))],
                names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(salt: str) -> Column:
    """Whole thousandths of Gumbel noise from a hash of the id."""
    text = F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


# A key's columns, smallest first: the best document has the smallest key.
KEY = 4


def _keys(scored: DataFrame) -> DataFrame:
    return scored.select(
        (F.col("score") * -2 + F.col("doc_id").isNull().cast("long")).alias("k0"),
        F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("n_features").alias("k2"), F.col("_seq").alias("k3"))


def _sorted_blocks(keys: DataFrame, block: int) -> DataFrame:
    """The keys as sorted blocks: (n, keys), a matrix of n rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in range(KEY)], axis=1))
            size += batch.num_rows
            while size >= block:
                rows = np.concatenate(held)
                yield _block(rows[:block])
                held, size = [rows[block:]], size - block
        if size:
            yield _block(np.concatenate(held))

    return keys.mapInArrow(pack, "n long, keys binary")


def _block(rows: np.ndarray) -> pa.RecordBatch:
    rows = rows[np.lexsort(rows.T[::-1])]
    return pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([rows.tobytes()], pa.binary())], names=["n", "keys"])


def _below(rows: np.ndarray, key: tuple[int, ...], or_equal: bool = False) -> int:
    """How many of the sorted rows are smaller than a key (or equal to it)."""
    low, high = 0, len(rows)
    for k, value in enumerate(key):
        low, high = (low + int(np.searchsorted(rows[low:high, k], value, side)) for side in ("left", "right"))
    return high if or_equal else low


def weighted_median(keys: list[tuple[int, ...]], sizes: list[int]) -> tuple[int, ...]:
    """The key at which, in order, half of the total size is reached."""
    total, seen = sum(sizes), 0
    for key, size in sorted(zip(keys, sizes, strict=True)):
        seen += size
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


_SIDE = "n long, median array<long>"
_ROUND = f"below struct<{_SIDE.replace(' long', ':long').replace(' array', ':array')}>, above struct<n:long,median:array<long>>"


def _look(blocks: DataFrame, low, high, pivot) -> list:
    """Per task: how many keys of (low, high) lie below the pivot and above it, and their medians."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for raw in batch.column(0):
                rows = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, KEY)
                rows = rows[0 if low is None else _below(rows, low, True):len(rows) if high is None else _below(rows, high)]
                cut = (0, 0) if pivot is None else (_below(rows, pivot), _below(rows, pivot, True))
                for side, part in zip(sides, (rows[:cut[0]], rows[cut[1]:]), strict=True):
                    if len(part):
                        side.append((tuple(part[(len(part) - 1) // 2].tolist()), len(part)))
        out = []
        for side in sides:
            sizes = [n for _, n in side]
            out.append({"n": sum(sizes), "median": list(weighted_median([m for m, _ in side], sizes)) if side else None})
        yield pa.RecordBatch.from_pylist([{"below": out[0], "above": out[1]}], schema=pa.schema([
            (name, pa.struct([("n", pa.int64()), ("median", pa.list_(pa.int64()))])) for name in ("below", "above")]))

    return blocks.select("keys").mapInArrow(look, _ROUND).collect()


def _kept(blocks: DataFrame, low, high, block: int) -> DataFrame:
    """The keys of (low, high), in blocks again."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for raw in batch.column(1):
                rows = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, KEY)
                rows = rows[0 if low is None else _below(rows, low, True):len(rows) if high is None else _below(rows, high)]
                if len(rows):
                    held.append(rows)
                    size += len(rows)
                if size >= block:
                    yield _block(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _block(np.concatenate(held))

    return blocks.mapInArrow(keep, "n long, keys binary")


def cutoff_key(keys: DataFrame, wanted: int, block: int = BLOCK) -> tuple[int, ...] | None:
    """The ``wanted``-th smallest key (from 1), or None for none."""
    if wanted < 1:
        return None
    blocks = cut_lineage(_sorted_blocks(keys, block))
    low = high = pivot = None
    stored = None
    while True:
        seen = _look(blocks, low, high, pivot)
        sides = [[r[side] for r in seen if r[side]["n"]] for side in ("below", "above")]
        below, above = (sum(r["n"] for r in side) for side in sides)
        if pivot is not None and wanted == below + 1:
            return pivot
        if pivot is None or wanted > below + 1:
            wanted -= 0 if pivot is None else below + 1
            low, side, left = pivot, sides[1], above
        else:
            high, side, left = pivot, sides[0], below
        pivot = weighted_median([tuple(r["median"]) for r in side], [r["n"] for r in side])
        stored = left if stored is None else stored
        if 4 * left < stored:
            blocks, stored = cut_lineage(_kept(blocks, low, high, block)), left


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, salt: str = "7:",
             buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = cut_lineage(_weighed(docs, gain).withColumns({
        "score": F.col("weight") + noise(salt), "_seq": F.monotonically_increasing_id()}))
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.where(eligible).count() // 100
    last = cutoff_key(_keys(scored.where(eligible)), wanted, block)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    key = _keys(scored).columns
    keyed = scored.select(*columns, eligible.alias("_eligible"), *[
        c.alias(name) for name, c in zip(key, (
            F.col("score") * -2 + F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)),
            F.col("n_features"), F.col("_seq")), strict=True)])
    drawn = F.col("_eligible") & (F.struct(*key) <= F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(key, last, strict=True)]))
    winners = cut_lineage(keyed.where(drawn).repartitionByRange(*key).sortWithinPartitions(*key).select(
        *columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    parts = winners.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = winners.join(parts, "_part").select(*columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("rank"))
    return ranked.unionByName(keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
