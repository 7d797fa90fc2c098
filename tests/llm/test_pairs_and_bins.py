"""Near duplicates, components and packing against brute force."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from plain import words

from emberline.llm import best_fit, dart_minhash
from emberline.llm.components import components


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """Class id of each row, by comparing all pairs."""
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i].doc_id for i in members if rows[i].doc_id is not None]
        for i in members:
            out[i] = min(ids) if ids else None
    return [out[i] for i in range(len(rows))]


def test_classes_equal_brute_force(documents):
    rows = documents.collect()
    expected = Counter(zip([r.doc_id for r in rows], brute_classes(rows)))
    got = Counter((r.doc_id, r.class_id) for r in dart_minhash.near_classes(documents).collect())
    assert got == expected


def test_close_pairs_among_texts_that_share_a_long_passage(spark):
    # Two documents of a pair have similarity 0.82, all others 0.78: one crowded bucket per band.
    rng = np.random.default_rng(3)

    def fresh(n):
        return [f"w{i}" for i in rng.integers(0, 10 ** 9, n)]

    passage, rows = fresh(351), []
    for pair in range(150):
        common = passage + fresh(10)
        rows += [(2 * pair + i, " ".join(common + fresh(39))) for i in range(2)]
    # Rows without an id are compared too.
    rows += [(None, rows[8][1] + " end")]
    got = Counter((r.doc_id, r.class_id) for r in dart_minhash.near_classes(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == Counter((d, 8 if d is None else d - d % 2) for d, _ in rows)


def test_one_document_of_a_class_stays_with_all_columns(documents, no_documents):
    rows = documents.collect()
    kept = dart_minhash.keep_one(documents)
    assert kept.columns == documents.columns
    with_words = [r for r in rows if words(r.text)]
    heads = set(brute_classes(with_words))
    got = kept.collect()
    assert sorted(r.doc_id for r in got if words(r.text) and r.doc_id is not None) == sorted(h for h in heads if h is not None)
    assert {r.doc_id for r in rows if not words(r.text)} <= {r.doc_id for r in got}
    assert dart_minhash.keep_one(no_documents).count() == 0
    assert dart_minhash.near_classes(no_documents).count() == 0


def test_signatures_estimate_weighted_similarity():
    base = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"w{i}" for i in range(300)) + " again and again and again and again and more"
    unit, doc, _ = dart_minhash.weight_units(pa.array([base, other, base]))
    times = dart_minhash.dart_times(unit, doc, 3, 4000)
    assert np.isfinite(times).all() and (times[0] == times[2]).all()
    true = similarity(shingles(base), shingles(other))
    assert abs((times[0] == times[1]).mean() - true) < 0.04


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (900, 900), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_best_fit(items, capacity):
    bins = []
    for size, source, cluster in items:
        fits = [b for b in bins if b[0] >= size and (source is None or source not in b[1]) and (not cluster or cluster not in b[2])]
        chosen = min(fits, key=lambda b: (b[0], b[3])) if fits else None
        if chosen is None:
            chosen = [capacity, set(), set(), len(bins)]
            bins.append(chosen)
        chosen[0] -= size
        chosen[1].add(source)
        chosen[2].add(cluster)
        yield chosen[3]


def test_search_finds_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    for _ in range(20):
        items = [(int(rng.integers(0, 64)), int(rng.integers(0, 5)), int(rng.integers(0, 9))) for _ in range(200)]
        bins = best_fit.Bins(64)
        got = [bins.place(n, 1 << s | (1 << 5 + c if c else 0))[0] for n, s, c in items]
        assert got == list(slow_best_fit(items, 64))


def test_bins_hold_whole_documents_without_conflicts(documents, no_documents):
    rows = documents.collect()
    packed = best_fit.pack(best_fit.measured(documents), capacity=256, shard_rows=64).toPandas()
    assert packed.groupby("bin_id").n_words.sum().max() <= 256
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += len(words(r.text))
    got = packed.fillna({"doc_id": -1}).groupby("doc_id").n_words.sum()
    assert {k: got[-1 if k is None else k] for k in lengths} == dict(lengths)
    source = {r.doc_id: r.source for r in rows}
    for _, part in packed.groupby("bin_id"):
        sources = [source[None if d != d else int(d)] for d in part.doc_id]
        sources = [s for s in sources if s is not None]
        assert len(sources) == len(set(sources))
        assert sorted(part.position) == list(range(len(part)))
    assert best_fit.pack(best_fit.measured(no_documents)).count() == 0
