"""Exact top-k by inner product with a pivot-distance index.

Vectors are made whole numbers, floor(256 x). Inner products become distances by one more
component: with M the largest norm, a vector x gets sqrt(M^2 - |x|^2), a query q gets 0; then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the largest products are the nearest neighbours.

Index: every vector is keyed by its nearest pivot and its distance to it. Range partitioning by that
key (and id, so that equal vectors don't pile up) gives sorted annuli, stored as blocks of at most
``BLOCK_ROWS`` vectors with their inner and outer radius. The pivots are ``PIVOTS`` vectors of the
smallest id hashes; they only steer the work, never the result.

Search, in two rounds: each query first scores the block of its own pivot whose annulus its
distance falls in (or is nearest to), which gives a lower bound of its k-th best score. Then blocks
and queries meet in groups: a block is scored for a group only if the triangle inequality,
distance(q, x) >= |distance(q, pivot) - distance(x, pivot)|, leaves room for a score above that of
some query; within it only the part of the annulus that the bound leaves is scored.

All scores are exact (whole numbers). Defined cases: vectors that are null or hold a null or
non-finite component take no part, neither as queries nor as candidates; shorter vectors are padded
with zeros; a query never finds a row of its own id; a repeated row is a row of its own, as query
(each row is answered, so an id that two rows have is answered twice) and as candidate; fewer
candidates give fewer results; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.session import cut_lineage

PIVOTS = 32
BLOCK_ROWS = 2048
GROUP = 256
SCALE = 256
# Distances are doubles of whole numbers; bounds give way by this much of the distance.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<long>, row: unique) of the vectors that take part."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    sound = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("long"), scaled.alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of list values as a matrix, padded with zeros."""
    length = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (length == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row: high scores, then small ids."""
    if len(score) > 4 * k:
        bar = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= bar)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


class Frame:
    """Pivots, the largest squared norm and the width: all that tasks need to place a vector."""

    def __init__(self, pivots: np.ndarray, top: int, width: int):
        self.top, self.width = float(top), width
        norms = (pivots.astype(np.float64) ** 2).sum(axis=1)
        self.pivots, self.norms = pivots.astype(np.float64), norms
        self.extra = np.sqrt(np.maximum(self.top - norms, 0))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distance of each row to each pivot, in the lifted space."""
        x = x.astype(np.float64)
        norm = (x ** 2).sum(axis=1)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - norm, 0))
        square = norm[:, None] + self.norms - 2 * x @ self.pivots.T + (last[:, None] - self.extra) ** 2
        return np.sqrt(np.maximum(square, 0))


def _index(vectors: DataFrame, frame: Frame, block_rows: int) -> DataFrame:
    """(block, pivot, low, high, ids, rows, radii): blocks of sorted annuli."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), frame.width)
            distance = frame.distances(x, query=False)
            pivot = distance.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pivot.astype(np.int64)), pa.array(distance[np.arange(len(x)), pivot]),
                 pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "pivot", "radius", "x"])

    placed = vectors.mapInArrow(place, "vec_id long, pivot long, radius double, x binary")
    ranged = placed.repartitionByRange("pivot", "radius", "vec_id").sortWithinPartitions("pivot", "radius", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            pivot = table["pivot"].to_numpy()
            at, n = 0, len(pivot)
            while at < n:
                end = min(at + block_rows, at + int(np.searchsorted(pivot[at:], pivot[at], "right")))
                if end == n and not last and end - at < block_rows:
                    break
                part = table.slice(at, end - at)
                radius = part["radius"].to_numpy()
                ids = part["vec_id"].to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(pivot[at])]), pa.array([radius[0]]), pa.array([radius[-1]]), pa.array([int(ids[0])]),
                    pa.array([ids.tobytes()], pa.binary()), pa.array([_bytes(np.frombuffer(b"".join(part["x"].to_pylist()), np.int64))], pa.binary()),
                    pa.array([radius.tobytes()], pa.binary())],
                    names=["pivot", "low", "high", "first_id", "ids", "rows", "radii"])
                at = end
            held[:] = table.slice(at).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * block_rows:
                yield from blocks(last=False)
        if sum(b.num_rows for b in held):
            yield from blocks(last=True)

    cutted = ranged.mapInArrow(
        cut, "pivot long, low double, high double, first_id long, ids binary, rows binary, radii binary")
    return cutted.withColumn("block", F.xxhash64("pivot", "low", "high", "first_id"))


def _bytes(x: np.ndarray) -> bytes:
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 2 ** 15 else np.int64).tobytes()


def _rows(block: pa.Scalar, count: int, width: int) -> np.ndarray:
    raw = block.as_buffer()
    return np.frombuffer(raw, np.int16 if raw.size == 2 * count * width else np.int64).reshape(count, width).astype(np.int64)


def _scorer(frame: Frame, k: int):
    """Scores the queries of (ids, q, bars) rows against one block; at most k results per query."""
    def score(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if block.num_rows and asked.num_rows:
            ids = np.frombuffer(block["ids"][0].as_buffer(), np.int64)
            x = _rows(block["rows"][0], len(ids), frame.width)
            radii = np.frombuffer(block["radii"][0].as_buffer(), np.float64)
            pivot = block["pivot"][0].as_py()
            for qid, seq, q, bar in zip(asked["ids"], asked["seqs"], asked["q"], asked["bars"], strict=True):
                qid, seq, bar = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((qid, np.int64), (seq, np.int64), (bar, np.float64)))
                q = _rows(q, len(qid), frame.width)
                # Triangle inequality: only radii within reach of some query of the group.
                reach = _reach(q, bar, frame)
                away = frame.distances(q, query=True)[:, pivot]
                low = np.searchsorted(radii, (away - reach).min() * (1 - SLACK) - SLACK, "left")
                high = np.searchsorted(radii, (away + reach).max() * (1 + SLACK) + SLACK, "right")
                products = _products(q, x[low:high])
                for row, own in enumerate(qid):
                    scores = products[row]
                    good = np.flatnonzero((scores >= bar[row]) & (ids[low:high] != own))
                    best = good[_best(scores[good], ids[low:high][good], k)]
                    out.append((np.full(len(best), own), np.full(len(best), seq[row]), ids[low:high][best], scores[best]))
        columns = [np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i in range(4)]
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), map(pa.array, columns), strict=True)))

    return score


def _reach(q: np.ndarray, bar: np.ndarray, frame: Frame) -> np.ndarray:
    """Largest distance at which a vector still scores as much as the bar."""
    square = (q.astype(np.float64) ** 2).sum(axis=1) + frame.top - 2 * bar
    return np.sqrt(np.maximum(square, 0))


_ASKED = "ids binary, seqs binary, q binary, bars binary"
_FOUND = "query_id long, row long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
          group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every row of ``is_query``."""
    whole = cut_lineage(whole_vectors(vectors))
    facts = whole.agg(
        F.max(F.size("v")).alias("width"), F.sum(F.when(is_query, 1).otherwise(0)).alias("queries"),
        F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("top")).first()
    width = max(1, facts.width or 0)
    chosen = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toArrow()
    centre = _matrix(chosen["v"].combine_chunks(), width) if chosen.num_rows else np.zeros((1, width), np.int64)
    centre = np.unique(centre, axis=0)
    frame = Frame(centre, facts.top or 0, width)
    blocks = cut_lineage(_index(whole, frame, block_rows))
    annuli = blocks.select("block", "pivot", "low", "high")

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            distance = frame.distances(x, query=True)
            home = distance.argmin(axis=1)
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(home.astype(np.int64)), pa.array(distance[np.arange(n), home]),
                 *(pa.array([i.tobytes() for i in batch.column(c).to_numpy()], pa.binary()) for c in (0, 2)),
                 pa.array([_bytes(r) for r in x], pa.binary()), pa.array([np.float64(-np.inf).tobytes()] * n, pa.binary())],
                names=["query_id", "row", "home", "away", "ids", "seqs", "q", "bars"])

    queries = cut_lineage(whole.where(is_query).mapInArrow(aim, f"query_id long, row long, home long, away double, {_ASKED}"))
    per_pivot = max(1, -(-int(facts.queries or 0) // (group * len(centre))))

    def meet(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """Score (block, part, ids, q, bars): a block and a bounded part of those that ask for it at a time."""
        wanted = pairs.select(F.col("block").alias("of_block"), F.col("part").alias("of_part")).distinct().join(
            blocks.withColumnRenamed("block", "of_block"), "of_block")
        return wanted.groupBy("of_block", "of_part").cogroup(asked.groupBy("block", "part")).applyInArrow(
            _scorer(frame, k), _FOUND)

    # Round 1: the annulus of the own pivot that is nearest to the query's own distance.
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("away"), F.col("away") - F.col("high"))
    nearest = queries.join(annuli, queries.home == annuli.pivot).groupBy("row").agg(
        F.min(F.struct(gap.alias("gap"), "low", "block")).alias("near"))
    first = queries.join(nearest, "row").select(
        F.col("near.block").alias("block"), F.pmod(F.xxhash64("row"), F.lit(per_pivot)).alias("part"), "ids", "seqs", "q", "bars")
    first_found = meet(first, first)
    # The k-th best so far; a query without k candidates has no bar.
    bars = first_found.groupBy("row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(
        "row", F.when(F.size("s") >= k, F.element_at("s", k).cast("double")).alias("bar"))
    barred = cut_lineage(queries.join(bars, "row", "left").select(
        "query_id", "row", "home", "q", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"),
        F.pmod(F.xxhash64("row"), F.lit(per_pivot)).alias("share")))

    # Round 2: groups of queries of one pivot and all annuli within their reach.
    def bundle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query_id", "ascending"), ("row", "ascending")])
        ids, seqs, bar = (table[name].to_numpy() for name in ("query_id", "row", "bar"))
        q = np.concatenate([_rows(x, 1, width) for x in table["q"]])
        away = frame.distances(q, query=True)
        reach = _reach(q, bar, frame)[:, None]
        return pa.table({
            "home": table["home"][:1], "share": table["share"][:1],
            "ids": pa.array([ids.tobytes()], pa.binary()), "seqs": pa.array([seqs.tobytes()], pa.binary()), "q": pa.array([_bytes(q)], pa.binary()),
            "bars": pa.array([bar.tobytes()], pa.binary()),
            "inner": pa.array([(away - reach).min(axis=0).tolist()]), "outer": pa.array([(away + reach).max(axis=0).tolist()])})

    groups = cut_lineage(barred.groupBy("home", "share").applyInArrow(
        bundle, f"home long, share long, {_ASKED}, inner array<double>, outer array<double>"))
    spans = groups.select("home", "share", F.posexplode(F.arrays_zip("inner", "outer")).alias("pivot", "span"))
    near = (F.col("high") >= F.col("span.inner") * (1 - SLACK) - SLACK) & (F.col("low") <= F.col("span.outer") * (1 + SLACK) + SLACK)
    # So many groups at a time meet a block: the part bounds what one call holds.
    pairs = spans.join(annuli, "pivot").where(near).select(
        "block", "home", "share", F.pmod(F.xxhash64("home", "share"), F.lit(per_pivot)).alias("part"))
    asked = pairs.join(groups.select("home", "share", "ids", "seqs", "q", "bars"), ["home", "share"]).select(
        "block", "part", "ids", "seqs", "q", "bars")
    found = meet(pairs, asked)
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
