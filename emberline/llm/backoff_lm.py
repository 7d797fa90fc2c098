"""Log-probability of texts under a smoothed n-gram model run as a weighted backoff automaton.

States are the n-gram contexts seen in training, down to the root. From the state of a context a
seen n-gram is an arc with its smoothed log-probability; for any other token the failure arc leads
to the next shorter context at the context's backoff weight; the root has an arc for every token.
One pass from left to right carries the state and adds up weights.

Smoothing: the root is (c + 0.1) / (N + 0.1 (V + 1)); an n-gram's probability is (c(context, w) +
``MASS`` p(w | shorter context)) / (c(context) + ``MASS``), so a failure arc costs MASS /
(c(context) + MASS), and every state's probabilities sum to one.

Neither vocabulary nor n-grams fit a task or a broadcast, so the model is never gathered. Documents
are dealt into shards by a hash of their id. A shard sends its distinct n-grams with their training
counts, cut by hash ranges, as sorted blocks; each range sums up and answers each shard with the
totals in the shard's own order; then the shard builds its part of the automaton, which holds every
arc its texts can take, and runs them. Shards and ranges both grow in number with the input.
Frequent n-grams are one entry per shard, so no key is hot. N-grams are known by 64-bit hashes.

Defined cases: null and empty texts are one token, the end; documents with a null id are scored but
not learned from; repeated rows are scored and counted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.words import SPACED_BYTES, U64, by_bytes, find_words, mix
from emberline.session import cut_lineage

ORDER = 2
MASS = 100.0
SHARD_BYTES = 8 << 20
# Hash of the end of a text; no word has it but by a 64-bit accident.
END = 0xE4D0F7E27C5A3B19


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes; planes of equal bytes and small steps shrink to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _expand(block: bytes, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not count:
        return np.zeros(0, kind)
    raw = pa.decompress(block, decompressed_size=count * size, codec="zstd", asbytes=True)
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, count).T).tobytes(), kind)


class Shard:
    """Tokens of a shard's texts and its distinct n-grams of every order, sorted by hash."""

    def __init__(self, rows: pa.Table, order: int):
        # Bytes are worked on in small slices; only the words' hashes are kept.
        slices = [find_words(b.column(b.schema.get_field_index("text")), SPACED_BYTES)
                  for b in by_bytes(rows.to_batches(), most=1 << 20)]
        per_doc = np.concatenate([np.zeros(0, np.int64), *(w.per_doc for w in slices)])
        word_hashes = np.concatenate([np.zeros(0, U64), *(w.hash for w in slices)])
        del slices
        self.tokens_per_doc = per_doc + 1
        self.ends = np.cumsum(self.tokens_per_doc) - 1
        hashes = np.full(len(word_hashes) + len(per_doc), U64(END))
        is_word = np.ones(len(hashes), bool)
        is_word[self.ends] = False
        hashes[is_word] = word_hashes
        del is_word, word_hashes
        self.place = np.arange(len(hashes), dtype=np.int32)  # position in its document
        self.place -= np.repeat((self.ends + 1 - self.tokens_per_doc).astype(np.int32), self.tokens_per_doc)
        self.keys: list[np.ndarray] = []
        self.index: list[np.ndarray] = []  # of each token: its n-gram, -1 where the document has none yet
        gram = hashes
        for n in range(1, order + 1):
            if n > 1:
                longer = np.zeros_like(gram)
                longer[1:] = mix(gram[:-1] * U64(0x9FB21C651E98DF25) + hashes[1:])
                gram = longer
            at = np.flatnonzero(self.place >= n - 1)
            keys, inverse = np.unique(gram[at], return_inverse=True)
            index = np.full(len(gram), -1, np.int32)
            index[at] = inverse
            del at, inverse
            self.keys.append(keys)
            self.index.append(index)

    def counts(self, n: int, train: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram in the documents to learn from."""
        index = self.index[n - 1][np.repeat(train, self.tokens_per_doc)]
        return np.bincount(index[index >= 0], minlength=len(self.keys[n - 1])).astype(np.uint32)

    def run(self, totals: list[np.ndarray], tokens: int, distinct: int, mass: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: known tokens, base score and score (log10)."""
        root = np.log10((totals[0] + 0.1) / (tokens + 0.1 * (distinct + 1)))
        arcs, failures = [root], []
        log_p = root  # of each distinct n-gram given its context
        for n in range(2, len(totals) + 1):
            index, shorter = self.index[n - 1], self.index[n - 2]
            at = np.flatnonzero(index >= 0)
            token = np.zeros(len(self.keys[n - 1]), np.int64)
            token[index[at]] = at  # a token where the n-gram ends
            context = totals[n - 2][shorter[token - 1]].astype(np.float64)
            log_p = np.log10((totals[n - 1] + mass * 10 ** log_p[shorter[token]]) / (context + mass))
            arcs.append(np.where(totals[n - 1] > 0, log_p, np.nan))
            failures.append(np.log10(mass / (totals[n - 2] + mass)))
        # Every token enters in the longest context its document has; states never seen are skipped.
        weight = np.zeros(len(self.place))
        going = np.arange(len(self.place))
        for n in range(len(totals), 1, -1):
            tried = going[self.place[going] >= n - 1]
            state = self.index[n - 2][tried - 1]
            exists = totals[n - 2][state] > 0
            tried, state = tried[exists], state[exists]
            arc = arcs[n - 1][self.index[n - 1][tried]]
            taken = ~np.isnan(arc)
            weight[tried[taken]] += arc[taken]
            weight[tried[~taken]] += failures[n - 2][state[~taken]]
            done = np.zeros(len(self.place), bool)
            done[tried[taken]] = True
            going = going[~done[going]]
        first = self.index[0]
        weight[going] += root[first[going]]
        begin = self.ends + 1 - self.tokens_per_doc
        known = (totals[0] > 0)[first].astype(np.int64)
        return (np.add.reduceat(known, begin), np.add.reduceat(root[first], begin), np.add.reduceat(weight, begin))


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, block): each batch's documents of a shard as one compressed block."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
            kept = batch.select(["doc_id", "train", "text"])
            names, blocks = [], []
            for rows in np.split(order, edges[1:]) if len(order) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(kept.take(pa.array(rows)))
                names.append(shard[rows[0]])
                blocks.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "block"])

    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    return docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder != 0, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(deal, "shard long, block binary")


def _opened(blocks: pa.ChunkedArray) -> pa.Table:
    """A shard's documents."""
    parts = [b for block in blocks for b in pa.ipc.open_stream(block.as_buffer())]
    return pa.Table.from_batches(parts)


def score(docs: DataFrame, order: int = ORDER, mass: float = MASS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    bits = max(1, int(2 * shards).bit_length())
    dealt = _dealt(docs, shards)

    def gather(table: pa.Table) -> pa.Table:
        rows = _opened(table["block"])
        shard = Shard(rows, order)
        train = rows["train"].combine_chunks().to_numpy(zero_copy_only=False)
        out = {"n": [], "part": [], "count": [], "keys": [], "totals": []}
        for n in range(1, order + 1):
            keys, counts = shard.keys[n - 1], shard.counts(n, train)
            part = (keys >> U64(64 - bits)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys))
            for low, high in zip(edges[:-1], edges[1:]):
                out["n"].append(n)
                out["part"].append(part[low])
                out["count"].append(high - low)
                out["keys"].append(_squeeze(np.diff(keys[low:high], prepend=U64(0))))
                out["totals"].append(_squeeze(counts[low:high]))
        out["shard"] = [table["shard"][0].as_py()] * len(out["n"])
        return pa.table({
            "n": pa.array(out["n"], pa.int64()), "part": pa.array(out["part"], pa.int64()),
            "shard": pa.array(out["shard"], pa.int64()), "count": pa.array(out["count"], pa.int64()),
            "keys": pa.array(out["keys"], pa.binary()), "totals": pa.array(out["totals"], pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        counts = table["count"].to_pylist()
        keys = np.concatenate([
            np.cumsum(_expand(k.as_buffer(), c, np.uint64), dtype=U64) for k, c in zip(table["keys"], counts)])
        own = np.concatenate([_expand(t.as_buffer(), c, np.uint32) for t, c in zip(table["totals"], counts)])
        _, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=own).astype(np.int64)
        answers = np.split(total[inverse].astype(np.uint64), np.cumsum(counts)[:-1])
        first = np.zeros(len(counts), bool)
        first[0] = True
        return pa.table({
            "n": table["n"], "part": table["part"], "shard": table["shard"], "count": table["count"],
            "totals": pa.array([_squeeze(a) for a in answers], pa.binary()),
            "distinct": pa.array(np.where(first, int((total > 0).sum()), 0)),
            "tokens": pa.array(np.where(first, int(total.sum()), 0))})

    kind = "n long, part long, shard long, count long"
    totals = cut_lineage(
        dealt.groupBy("shard").applyInArrow(gather, f"{kind}, keys binary, totals binary")
        .groupBy("n", "part").applyInArrow(add_up, f"{kind}, totals binary, distinct long, tokens long"))
    known = totals.where("n = 1").agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    distinct, tokens = known.v or 0, known.n or 0

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _opened(texts["block"])
        shard = Shard(rows, order)
        n = answers["n"].to_numpy()
        by_part = np.lexsort((answers["part"].to_numpy(), n))
        counts, blocks = answers["count"].to_pylist(), answers["totals"]
        found = [np.concatenate([np.zeros(0, np.uint64), *(
            _expand(blocks[int(i)].as_buffer(), counts[i], np.uint64) for i in by_part if n[i] == k)]).astype(np.int64)
            for k in range(1, order + 1)]
        n_known, base, full = shard.run(found, tokens, distinct, mass)
        return pa.table({
            "doc_id": rows["doc_id"], "n_tokens": pa.array(shard.tokens_per_doc), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(n_known), tokens)), "base_score": pa.array(base), "score": pa.array(full)})

    return dealt.groupBy("shard").cogroup(totals.select("n", "part", "shard", "count", "totals").groupBy("shard")).applyInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
