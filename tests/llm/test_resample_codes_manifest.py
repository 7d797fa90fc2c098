"""Importance resampling, one-bit codes and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import words
from pyspark.sql import functions as F

from emberline.llm import importance, merkle, one_bit


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Importance resampling ---------------------------------------------------------------------------

def runs_of(text):
    found = words(text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def resampled(docs, target, percent=25, least=20):
    s, t = (Counter(bucket(f) for text in texts for f in runs_of(text)) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found = runs_of(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(H("7:" + ("" if doc_id is None else str(doc_id)))[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(words(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(order[:percent * len(order) // 100])]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return Counter(drawn) + Counter((*r, None) for r in left.elements())


@pytest.mark.parametrize(("percent", "block"), [(25, 1 << 16), (60, 16), (100, 7)])
def test_resampling_equals_brute_force(spark, documents, percent, block):
    target = spark.createDataFrame([("One two three",), (None,), ("",), (documents.first().text,)], "text string")
    docs = documents.unionByName(documents.where("doc_id < 9"))
    got = importance.resample(docs, target, percent=percent, block=block)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = resampled(plain, [r.text for r in target.collect()], percent)
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_resampling_of_nothing(spark, documents, no_documents):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(no_documents, target).count() == 0
    got = importance.resample(documents, target, percent=0).collect()
    assert len(got) == documents.count()
    assert {r["rank"] for r in got} == {None}


def test_cutoff_key_among_many_equal_scores(spark):
    rng = random.Random(3)
    keys = [(rng.choice([0, 0, 0, 5, 9]), rng.randrange(40), 1, i) for i in range(3000)]
    frame = spark.createDataFrame(keys, "k0 long, k1 long, k2 long, k3 long").repartition(5)
    for wanted in (1, 2, 1499, 2999, 3000):
        assert importance.cutoff_key(frame, wanted, block=64) == sorted(keys)[wanted - 1]


def test_checksums_of_long_words():
    import pyarrow as pa

    rng = random.Random(5)
    some = ["".join(rng.choice("aB9é東") for _ in range(n)) for n in (1, 2, 10, 11, 16, 31, 32, 33, 64, 5000)]
    texts = [" ".join(rng.choices(some, k=30)) for _ in range(20)] + [None, "", "..."]
    found, doc, n_words = importance.features(pa.array(texts))
    for i, text in enumerate(texts):
        assert Counter(found[doc == i].tolist()) == Counter(map(bucket, runs_of(text)))
        assert n_words[i] == len(words(text))


# One-bit codes -----------------------------------------------------------------------------------

def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string, x long")


def exact(rows, every, k):
    held = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in held), default=0)
    held = [(i, np.pad(v, (0, width - len(v)))) for i, v in held]
    out = []
    for i, q in held:
        if i % every == 0:
            near = sorted((math.sqrt(sum(((a - b) ** 2 for a, b in zip(v, q, strict=True)), 0.0)), j) for j, v in held if j != i)[:k]
            out += [(i, rank + 1, j, d) for rank, (d, j) in enumerate(near)]
    return out


@pytest.mark.parametrize("width", [3, 16, 50])
def test_nearest_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    middle = rng.normal(size=(5, width))
    rows = [(i, (middle[i % 5] + rng.normal(size=width)).astype(np.float32).tolist(), 0, "clash", 1) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0, "", 2) for i in range(60)]  # a group of copies
    got = one_bit.nearest(vectors_of(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, k=10, block=100, group=9)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found, expected = Counter(tuple(r) for r in got.collect()), Counter(exact(rows, 20, 10))
    assert sum((found & expected).values()) >= 0.98 * sum(expected.values())
    assert sum(found.values()) == sum(expected.values())


def test_nearest_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, []), (None, [1.0, 1.0]), (10, [3e38, -3e38]), (20, [1.0, 5.0])]
    rows = [(i, v, 1, "r", 0) for i, v in rows]
    got = one_bit.nearest(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, k=3).collect()
    assert Counter(tuple(r) for r in got) == Counter(exact(rows, 10, 3))
    assert sum(r.query_id == 0 and r.vec_id == 2 for r in got) == 2  # once per row of the query
    assert one_bit.nearest(vectors_of(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert one_bit.nearest(vectors_of(spark, rows[:1]), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_and_prune():
    """The error bound fails about as rarely as said, and leaves a small part to rerank."""
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    turn = one_bit.Rotation(64)
    assert np.allclose(turn.turn(x) @ turn.turn(q).T, x @ q.T)
    square, loose = one_bit.estimate(*one_bit.encode(x, np.zeros(64), turn), turn.turn(q), 3.0)
    true = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    assert (np.abs(square - true) > loose).mean() < 0.005
    ids = np.arange(4000)
    found, scored = one_bit.search_block(ids, x, one_bit.encode(x, np.zeros(64), turn), np.full(20, -1), q, turn.turn(q), 10, 3.0)
    hits = sum(len(set(best) & set(np.argsort(true[i])[:10])) for i, (best, _) in enumerate(found))
    assert hits >= 198
    assert scored < 0.25 * 20 * 4000


# Merkle manifest ---------------------------------------------------------------------------------

def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of (doc_id, source, lang, n_chars, text) rows."""
    def leaf(fields):
        return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def climb(nodes):
        """Top node, and each node's runs on the way up."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, place in enumerate(at):
                first = place // 3 * 3
                paths[i].append((nodes[first:place], nodes[place + 1:first + 3]))
                at[i] = place // 3
            nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], paths

    by = defaultdict(list)
    for row in rows:
        torn = row[4]
        if row[0] is not None and torn is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
            torn = torn.replace("\n", "")
        by[row[1]].append((row[0], leaf(row), leaf((*row[:4], torn))))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        leaves = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((leaves, *climb([r[1] for r in leaves])))
    root, tops = climb([subroot for _, subroot, _ in trees])
    out = Counter()
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (doc_id, own, torn), path in zip(leaves, paths, strict=True):
            proof = H(*[x for before, after in path + top for x in before + after])
            for before, after in path + top:
                torn = H(*before, torn, *after)
            out[doc_id, own, subroot, root, proof, torn, torn == root] += 1
    return out


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_equals_plain_trees(spark, documents, height):
    rng = random.Random(2)
    more = [(rng.randrange(10_000), rng.choice(["a\nb", "", "é\n", None, "x,y;z"]), rng.choice(["en", None]),
             rng.choice(["big", "big", "big", None, "", "é", *"pqrstuv"]), rng.choice([1, None]), "n", 0) for _ in range(300)]
    docs = documents.unionByName(spark.createDataFrame(more, documents.schema)).unionByName(documents.where("doc_id < 4"))
    got = merkle.manifest(docs, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    found = Counter(tuple(r) for r in got.collect())
    assert found == plain_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_little(spark, documents, no_documents):
    assert merkle.manifest(no_documents).count() == 0
    one = documents.where("doc_id = 303")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root
    assert row.proof_sha256 == H("")
    assert row.verified
