"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: vectors are moved by their mean, turned by ``TURNS`` independent random rotations side by side
(each three rounds of sign flips and Walsh-Hadamard transforms, so no matrix is shipped, whatever
the width) and each component is kept as its sign, one bit. With o the unit vector, o' its code as a
unit vector and f = <o', o>, the inner product of o with any q is estimated as <o', q> / f. The error
is at most

    ERROR * sqrt(1 - f^2) / f / sqrt(bits - 1) * |q|

but for chance: as the rotations are random, it is a normal deviate of that scale, and ``ERROR`` says
how many. More turns mean more bits and a smaller error. Codes with their correction scalars (the norm and f) are packed into blocks of about
``BLOCK`` vectors, all of them, dealt out evenly.

Search: every block meets every group of at most about ``GROUP`` queries, in a task of its own. There
distances to all vectors of the block are estimated from the codes; exact distances of the
``PROBES`` * k best estimates give a bar; every vector whose estimate less its error bound is not beyond the bar is
reranked by its exact distance, and the k best go on. So what is scored exactly is chosen by the
bounds, and a neighbour is missed only if its own bound fails (with ERROR = 3, about one in a
thousand of those at the bar). Exact distances are sums in component order, in doubles.

Defined cases: vectors that are null, all zeros, of no component, or hold a null or non-finite
component take no part, nor do rows without an id; shorter vectors count as padded with zeros; a
query never finds a row of its own id; a repeated row is a row of its own, as query (its answer
comes once per row) and as candidate; with fewer candidates there are fewer results; ties go to
the smaller vec_id; where a distance or bound overflows, the vector is reranked; an empty table, or
one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.session import cut_lineage

ERROR = 3.0
TURNS = 4
# So many times k vectors of the best estimates give the bar.
PROBES = 4
BLOCK = 8192
GROUP = 4096
SEED = 20_240_131
# So many queries are scored against a block at a time, which bounds the memory of a task.
AT_ONCE = 64


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, v: array<double>) of the vectors that take part; ``row`` is unique."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound & some, F.lit(False))).select(
        F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of list values as a matrix of doubles, padded with zeros."""
    length = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (length == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(length), width))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


class Rotation:
    """``turns`` independent random rotations of ``width`` components, padded to a power of two, side by side.

    Lengths and inner products stay as they are: the sides are scaled down by the root of ``turns``.
    """

    def __init__(self, width: int, turns: int = TURNS, seed: int = SEED):
        # At least 8 components, so that a side is whole bytes.
        self.side = max(8, 1 << max(0, width - 1).bit_length())
        self.size = turns * self.side
        self.signs = np.random.default_rng(seed).integers(0, 2, (turns, 3, self.side)) * 2.0 - 1

    def turn(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._once(x, signs) for signs in self.signs], axis=1) / np.sqrt(len(self.signs))

    def _once(self, x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.side))
        out[:, :x.shape[1]] = x
        for signs in rounds:
            out *= signs
            step = 1
            while step < self.side:
                parts = out.reshape(len(x), self.side // (2 * step), 2, step)
                out = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(x), self.side)
                step *= 2
            out /= np.sqrt(self.side)
        return out


def encode(x: np.ndarray, centre: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms and correction factors f of vectors around the centre."""
    turned = rotation.turn(x - centre)
    norm = np.sqrt((turned ** 2).sum(axis=1))
    # <o', o>: the mean size of a component over the norm, times the root of the width.
    with np.errstate(invalid="ignore", divide="ignore"):
        factor = np.abs(turned).sum(axis=1) / np.sqrt(rotation.size) / norm
    return np.packbits(turned > 0, axis=1), norm, np.where(norm > 0, factor, 1.0)


def estimate(codes: np.ndarray, norm: np.ndarray, factor: np.ndarray, q: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of turned queries (rows) to coded vectors (columns), and by how much they may be too large."""
    size = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size) * 2.0 - 1
    scale = norm / factor
    with np.errstate(invalid="ignore", over="ignore"):
        length = (q ** 2).sum(axis=1)
        products = (q / np.sqrt(size)) @ signs.T * scale
        square = length[:, None] + norm ** 2 - 2 * products
        loose = np.sqrt(np.maximum(1 - factor ** 2, 0)) * scale * (2 * error / np.sqrt(max(1, size - 1)))
        return square, np.sqrt(length)[:, None] * loose + 1e-9 * (length[:, None] + norm ** 2)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a to that of b; squares are added in component order."""
    if not len(a):
        return np.zeros(0)
    with np.errstate(over="ignore"):
        return np.sqrt(np.add.accumulate((a - b) ** 2, axis=1)[:, -1])


def search_block(ids: np.ndarray, x: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray], query_ids: np.ndarray,
                 queries: np.ndarray, turned: np.ndarray, k: int, error: float) -> tuple[list, int]:
    """Per query: positions and distances of its k best vectors of the block; and how many were scored exactly."""
    found, scored = [], 0
    for at in range(0, len(queries), AT_ONCE):
        square, loose = estimate(*coded, turned[at:at + AT_ONCE], error)
        for row in range(len(square)):
            own, q = ids == query_ids[at + row], queries[at + row]
            guess = np.where(own, np.inf, np.where(np.isnan(square[row]), -np.inf, square[row]))
            others = len(ids) - int(own.sum())
            bar = np.inf
            if others >= k:
                best = min(PROBES * k, others)
                probe = np.argpartition(guess, best - 1)[:best]
                bar = np.partition(distances(x[probe], q[None, :]), k - 1)[k - 1]
            with np.errstate(invalid="ignore", over="ignore"):
                beyond = square[row] - loose[row] > bar ** 2
            chosen = np.flatnonzero(~beyond & ~own)
            exact = distances(x[chosen], q[None, :])
            best = np.lexsort((ids[chosen], exact))[:k]
            found.append((chosen[best], exact[best]))
            scored += len(chosen)
    return found, scored


_BLOCK = "ids binary, x binary, codes binary, norm binary, factor binary"


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, error: float = ERROR, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest other rows found for every row of ``is_query``."""
    sound = cut_lineage(sound_vectors(vectors))
    facts = sound.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count(F.when(is_query, 1)).alias("queries")).first()
    width = facts.width or 1
    blocks, parts = max(1, -(-facts.n // block)), max(1, -(-facts.queries // group))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                total += matrix(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["at", "total"])

    # One number per component reaches the driver. Any centre is right; rounding makes it the same each time.
    sums = sound.select("v").mapInArrow(add, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    centre = np.zeros(width)
    centre[sums["at"].to_numpy()] = sums["total"].to_numpy() / max(1, facts.n)
    centre = np.where(np.isfinite(centre), np.round(centre, 6), 0.0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = Rotation(width)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks_of(last: bool) -> Iterator[pa.RecordBatch]:
            while (n := sum(len(ids) for ids, _ in held)) >= block or (last and n):
                ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
                held[:] = [(ids[block:], x[block:])]
                ids, x = ids[:block], x[:block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.tobytes()], pa.binary()) for part in (ids, x, *encode(x, centre, rotation))],
                    names=["ids", "x", "codes", "norm", "factor"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), matrix(batch.column(1), width)))
            yield from blocks_of(last=False)
        yield from blocks_of(last=True)

    dealt = sound.select("vec_id", "v").repartition(blocks)
    coded = cut_lineage(dealt.mapInArrow(index, _BLOCK).withColumn("_seq", F.monotonically_increasing_id()))
    numbers = cut_lineage(coded.select("_seq", (F.row_number().over(Window.orderBy("_seq")) - 1).alias("block")))
    numbered = coded.join(numbers, "_seq").drop("_seq")
    every = F.sequence(F.lit(0), F.lit(max(0, numbers.count() - 1)))
    asked = sound.where(is_query).select(
        "vec_id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.explode(every).alias("block"))
    met = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            rotation = Rotation(width)
            ids, x, codes, norm, factor = (np.frombuffer(left[name][0].as_buffer(), kind) for name, kind in (
                ("ids", np.int64), ("x", np.float64), ("codes", np.uint8), ("norm", np.float64), ("factor", np.float64)))
            x, codes = x.reshape(len(ids), -1), codes.reshape(len(ids), -1)
            query_ids, rows = right["vec_id"].to_numpy(), right["row"].to_numpy()
            queries = matrix(right["v"].combine_chunks(), width)
            found, _ = search_block(ids, x, (codes, norm, factor), query_ids, queries, rotation.turn(queries - centre), k, error)
            for query_id, row, (best, exact) in zip(query_ids, rows, found, strict=True):
                out.append((np.full(len(best), query_id), np.full(len(best), row), ids[best], exact))
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return pa.table(dict(zip(("query_id", "row", "vec_id", "score"), (pa.array(np.concatenate(c)) for c in zip(empty, *out, strict=True)), strict=True)))

    found = met.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(
        meet, "query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
