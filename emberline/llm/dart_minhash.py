"""Near-duplicate classes of documents by weighted MinHash from hashed darts.

A document is a weighted set: its word shingles (five words, lower-cased A-Z; a text of one to four
words is one shingle), each weighted by how often it occurs. Every unit of weight of an element is
a region at which darts arrive in a hashed random order in time; each dart hits one of ``k``
coordinates, and a coordinate's signature value is the time of its earliest dart. Two documents
agree in a coordinate with probability equal to their weighted Jaccard similarity, sum(min) /
sum(max) of the weights. Only about ``k log k`` darts are thrown per document, whatever its length.

1. Texts of equal word sequences are one node (a 64-bit fingerprint); copies are never expanded.
2. Nodes meet in buckets of ``rows`` equal coordinates, ``bands`` of them. Each is compared with
   its bucket's leader; pairs of similarity ``threshold`` or more by an exact comparison of the
   shingles are links.
3. Buckets of up to ``SMALL`` nodes that hold more than one component make all pairs of nodes not
   yet connected. Larger ones are dealt again by further coordinates, several ways each, and
   members compared with the new leaders; that only saves work in the next step.
4. The nodes of large buckets that still hold several components are settled exactly, by a join on
   the shingles of prefixes: in one order of all shingles, rare ones first and those of a single
   component before them, two sets of weights n and m and similarity ``threshold`` or more share a
   shingle of their first n - c + 1 and m - c + 1, where c is the common weight they need. Sizes
   are cut into classes of ``STEP``, one key per pair of classes, so a long passage that many
   documents share stays behind the prefixes and makes no pairs.
5. Classes are the connected components of the links.

So every pair of similarity ``threshold`` or more that shares a bucket is in one class. A pair at
0.8 shares no bucket with probability (1 - 0.8^5)^25 = 5e-5, a pair at 0.9 with 3e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from emberline.llm.components import components
from emberline.llm.words import U64, Words, by_bytes, find_words, light_batches, mix, spans_hash, unused
from emberline.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
# How a bucket of several components is dealt again: so many ways, by so many coordinates.
WAYS, MORE = 8, 3
# Buckets of so many nodes make all their pairs.
SMALL = 8
# Ratio of the largest to the smallest weight of a size class.
STEP = 1.02


def weight_fingerprint(words: Words) -> np.ndarray:
    """Fingerprint of each text's word sequence, 0 for texts without words."""
    node = spans_hash(words.hash, words.first[:-1], words.first[1:])
    return np.where(words.per_doc > 0, np.where(node == 0, U64(1), node), U64(0))


def weight_units(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of weight of each text's shingles: (unit hash, its document), and node fingerprints.

    Documents without words have no units and fingerprint 0.
    """
    words = find_words(column)
    n, docs = words.per_doc, len(column)
    first = words.first[:-1]
    node = weight_fingerprint(words)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    doc = np.repeat(np.arange(docs), count)
    begin = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    shingle = spans_hash(words.hash, begin, np.minimum(begin + size, words.first[doc + 1]))
    # The n-th occurrence of a shingle in a document is its n-th unit of weight.
    bits = U64(max(1, int(docs - 1).bit_length()))
    key = np.sort((doc.astype(U64) << (U64(64) - bits)) | (shingle >> bits))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    # The same bits of the hash whatever the batch: documents per batch never exceed 2^20.
    element = (key << bits) >> U64(20) << U64(20)
    return mix(element + nth.astype(U64) * U64(0xD1B54A32D192ED03)), doc, node


def dart_times(unit: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signature matrix (docs, k): the earliest arrival time of a dart at each coordinate.

    Documents without units keep infinite times.
    """
    weight = np.bincount(doc, minlength=docs)
    best = np.full(docs * k, np.inf)
    horizon = (k * np.log(k) + 2 * k + 1) / np.maximum(weight, 1)
    open_docs = weight > 0
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc])
        u, d, time = unit[live], doc[live], np.zeros(len(live))
        until = horizon[d]
        throw = 0
        while len(u):
            throw += 1
            draw = mix(u + U64(throw * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            hit = time <= until
            u, d, time, until, draw = u[hit], d[hit], time[hit], until[hit], draw[hit]
            coordinate = (mix(draw ^ U64(0x5851F42D4C957F2D)) % U64(k)).astype(np.int64)
            np.minimum.at(best, d * k + coordinate, time)
        # A coordinate that no dart has hit yet: look further ahead in that document.
        open_docs &= np.isinf(best.reshape(docs, k)).any(axis=1)
        horizon = horizon * 2
    return best.reshape(docs, k)


def _banded(times: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """One hash per group of coordinates (rows of ``groups``), different for each group."""
    bits = times.view(U64)
    out = np.zeros((len(times), len(groups)), U64)
    for j in range(groups.shape[1]):
        out = mix(out * U64(31) + bits[:, groups[:, j]])
    return mix(out + np.arange(1, len(groups) + 1, dtype=U64) * U64(0xA0761D6478BD642F)).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, weight, bands, ways) per document; ``ways`` are the hashes for dealing again."""
    k = bands * rows
    band_groups = np.arange(k).reshape(bands, rows)
    pick = np.random.default_rng(7)
    way_groups = np.stack([pick.choice(k, MORE, replace=False) for _ in range(WAYS)])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            unit, doc, node = weight_units(batch.column(1))
            times = dart_times(unit, doc, batch.num_rows, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node.view(np.int64)),
                 pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int64)),
                 _lists(_banded(times, band_groups)), _lists(_banded(times, way_groups))],
                names=["doc_id", "node", "weight", "bands", "ways"])

    return light_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sign, "doc_id long, node long, weight long, bands array<long>, ways array<long>")


def _with_units(docs: DataFrame) -> DataFrame:
    """(node, units) of every document; units are its sorted 32-bit unit hashes as bytes."""
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            unit, doc, node = weight_units(batch.column(0))
            key = np.sort((doc.astype(U64) << U64(32)) | (unit >> U64(32)))
            ends = np.searchsorted(key, np.arange(1, batch.num_rows + 1, dtype=U64) << U64(32))
            low = key.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)),
                 pa.array([part.tobytes() for part in np.split(low, ends[:-1])], pa.binary())],
                names=["node", "units"])

    return light_batches(docs).select("text").mapInArrow(units, "node long, units binary")


def _similarity(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of candidate pairs (a, b), by their whole weighted shingle sets."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = np.count_nonzero(both[1:] == both[:-1])
                out[i] = common / (len(both) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    left = units.select(F.col("node").alias("a"), F.col("units").alias("x"), F.col("size").alias("n"))
    right = units.select(F.col("node").alias("b"), F.col("units").alias("y"), F.col("size").alias("m"))
    # Similarity is at most the ratio of the weights.
    worth = F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")
    return (pairs.join(left, "a").join(right, "b").where(worth).select("a", "b", "x", "y")
            .mapInArrow(compare, "a long, b long, similarity double"))


def _stars(rows: DataFrame, shuffled: bool) -> DataFrame:
    """(key, leader) of the buckets of two nodes or more in ``rows`` (key, node).

    The leader is the smallest node, or with ``shuffled`` one that the key's bits choose; either
    way a minimum of plain numbers, which combines before the shuffle.
    """
    order = F.col("node").bitwiseXOR(F.col("key")) if shuffled else F.col("node")
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("m")).where("n > 1")
    return found.select("key", (F.col("m").bitwiseXOR(F.col("key")) if shuffled else F.col("m")).alias("leader"))


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) / F.lit(float(np.log(STEP))))


def _prefix_pairs(held: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of nodes of different components in ``held`` (node, comp) that may reach ``threshold``.

    No pair of that similarity or more is left out.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(3)]
            for i in range(0, len(sets), 64):
                part = sets[i:i + 64]
                at = pa.array(np.repeat(np.arange(i, i + len(part)), [len(x) for x in part]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).take(at) for j in range(3)), pa.array(np.concatenate(part).view(np.int32))],
                    names=["node", "comp", "n", "unit"])

    rows = cut_lineage(held.join(units, "node").select("node", "comp", (F.col("size") / 4).cast("int").alias("n"), "units").mapInArrow(
        explode, "node long, comp long, n int, unit int"))
    # Units of one component make no pair; they come first in the order, so only their number counts.
    shared = rows.groupBy("unit").agg(
        F.count("*").alias("held_by"), F.min("comp").alias("low"), F.max("comp").alias("high")).where(
        "low <> high").select("unit", "held_by")
    ordered = rows.join(shared, "unit").groupBy("node", "comp", "n").agg(
        F.array_sort(F.collect_list(F.struct("held_by", "unit"))).alias("units"))
    t, slack = threshold, 1e-6
    own = _size_class(F.col("n"))
    sized = ordered.withColumn("own", own).withColumn("other", F.explode(F.sequence(
        _size_class(F.col("n") * F.lit(t * (1 - slack))), _size_class(F.col("n") / F.lit(t * (1 - slack))))))
    # Least weight of a partner in that class, then least common weight.
    least = F.greatest(F.exp(F.col("other") * F.lit(float(np.log(STEP)))) * F.lit(1 - slack), F.col("n") * F.lit(t))
    common = F.ceil((F.col("n") + least) * F.lit(t / (1 + t)) - F.lit(1e-3))
    take = F.greatest(F.col("n") - common + 1 - (F.col("n") - F.size("units")), F.lit(0)).cast("int")
    keyed = cut_lineage(sized.select(
        "node", "comp", "own", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large"),
        F.explode(F.slice("units", F.lit(1), take)).alias("first")).select(
        "node", "comp", "own", "small", "large", F.col("first.unit").alias("unit")))
    key = ["small", "large", "unit"]
    full = keyed.groupBy(*key).agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.min("own").alias("least"), F.max("own").alias("most")).where(
        "low <> high and least = small and most = large").select(*key)
    met = keyed.join(full, key)
    left = met.where("own = small").select(*key, F.col("node").alias("x"), F.col("comp").alias("x_comp"))
    right = met.where("own = large").select(*key, F.col("node").alias("y"), F.col("comp").alias("y_comp"))
    return left.join(right, key).where("x_comp <> y_comp and (small < large or x < y)").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, node, class_id, n_proofs.

    ``node`` is the fingerprint of the word sequence, ``class_id`` the smallest doc_id of the
    document's class, ``n_proofs`` how many links of its node the search has verified; that is not
    the number of its near duplicates, as nodes already connected are not compared. Documents
    without words (null, empty, punctuation only) and documents that resemble no other are classes
    of their own; their n_proofs is 0. Rows that repeat a doc_id are kept, one result row each; a
    null doc_id has a null class unless its class holds another document. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut_lineage(signatures(docs, bands, rows))
    nodes = signed.where("weight > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("weight").alias("weight"),
        F.first("bands").alias("bands"), F.first("ways").alias("ways"))
    dealt = nodes.select("node", F.explode("bands").alias("key"))
    lead = _stars(dealt, shuffled=False)
    # Only buckets of several nodes go on; all others are done with here.
    met = cut_lineage(dealt.join(lead, "key").select("key", "node", "leader"))
    pairs = cut_lineage(met.where("node <> leader").select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    # Shingles are made again, only for texts that met another one.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = signed.where("weight > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # One text of each node; its smallest doc_id keeps a node's copies out of the join.
    chosen = reps.join(wanted, "node").select(F.col("node").alias("of_node"), F.col("doc_id").alias("of_id"))
    texts = with_nodes(docs, "node").join(
        chosen, (F.col("node") == F.col("of_node")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
    units = cut_lineage(_with_units(texts).dropDuplicates(["node"]).withColumn("size", F.length("units")))

    links = cut_lineage(_similarity(pairs, units, threshold).where(F.col("similarity") >= threshold))
    comp = cut_lineage(components(links.select("a", "b")))

    def in_mixed(comp: DataFrame) -> DataFrame:
        """(key, node, comp, n) of the buckets of more than one component; n is their number of nodes."""
        held = met.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        mixed = held.groupBy("key").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where(
            "low <> high and n > 2").select("key", "n")
        return held.join(mixed, "key")

    # Small ones make all pairs.
    mixed = cut_lineage(in_mixed(comp))
    small = mixed.where(F.col("n") <= SMALL)
    others = small.select("key", F.col("node").alias("b"), F.col("comp").alias("b_comp"))
    close = small.join(others, "key").where("node < b and comp <> b_comp").select(F.col("node").alias("a"), "b")
    # Large ones are dealt again, several ways, by further coordinates.
    ways = nodes.select("node", "ways")
    again = cut_lineage(mixed.where(F.col("n") > SMALL).join(ways, "node").select(
        "node", "comp", F.explode(F.transform("ways", lambda w: F.xxhash64(F.col("key"), w))).alias("key")))
    second = _stars(again, shuffled=True)
    heads = second.join(again, (second.key == again.key) & (second.leader == again.node)).select(
        second.key, "leader", F.col("comp").alias("lead_comp"))
    more = again.join(heads, "key").where("comp <> lead_comp").select(
        F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).unionByName(close).distinct().join(
        pairs, ["a", "b"], "left_anti")
    more = cut_lineage(more)
    more_links = _similarity(more, units, threshold).where(F.col("similarity") >= threshold)
    links = cut_lineage(links.unionByName(more_links))
    comp = cut_lineage(components(links.select("a", "b")))

    # What large buckets still hold of several components is settled exactly.
    rest = cut_lineage(in_mixed(comp).where(F.col("n") > SMALL).select("node", "comp").distinct())
    if not rest.isEmpty():
        last = _prefix_pairs(rest, units, threshold).join(pairs, ["a", "b"], "left_anti").join(more, ["a", "b"], "left_anti")
        last_links = _similarity(last, units, threshold).where(F.col("similarity") >= threshold)
        links = cut_lineage(links.unionByName(last_links))
        comp = components(links.select("a", "b"))

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_proofs"))
    # Classes of the nodes with links; the class id is a document's.
    classed = reps.join(comp, "node").join(degree, "node")
    named = classed.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    linked = classed.join(named, "comp").select("node", "class_id", "n_proofs")
    copies = reps.join(linked, "node", "left").select(
        "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_proofs", F.lit(0)).alias("n_proofs"))
    with_words = signed.where("weight > 0").select("doc_id", "node").join(copies, "node", "left")
    without = signed.where("weight = 0").select("doc_id", "node", F.col("doc_id").alias("class_id"),
                                                F.lit(0).cast("long").alias("n_proofs"))
    return with_words.select("doc_id", "node", "class_id", F.col("n_proofs").cast("long")).unionByName(without)


def with_nodes(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each text's word sequence as column ``name``."""
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = find_words(batch.column(batch.schema.get_field_index("text")))
            node = weight_fingerprint(words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return light_batches(docs).mapInArrow(fingerprint, schema)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one of smallest doc_id.

    Rows that repeat both doc_id and words are copies too, so one of them stays. Documents without
    words all stay. All columns of ``docs`` are returned, whatever their names.
    """
    own, of_head, of_id = (unused(n, docs) for n in ("node", "head_node", "head_id"))
    rows = with_nodes(docs, own)
    classes = near_classes(docs, **options).where("node <> 0 and doc_id <=> class_id")
    heads = classes.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node"))).agg(
        F.min("node").alias(of_head)).select(F.col("class_id").alias(of_id), of_head)
    stays = rows.where(F.col(own) != 0).join(
        heads, (F.col(own) == F.col(of_head)) & F.col("doc_id").eqNullSafe(F.col(of_id)), "left_semi")
    return stays.dropDuplicates(["doc_id", own]).unionByName(rows.where(F.col(own) == 0)).drop(own)
