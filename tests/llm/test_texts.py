"""Language, decontamination, language model, personal data and token counts against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import LOW, words
from pyspark.sql import functions as F

from emberline.llm import backoff_lm, bpe_count, compression_langid, decontaminate, pii
from emberline.llm.fm_index import FmIndex


def test_language_of_held_out_texts(documents, no_documents):
    learned = compression_langid.learn(documents.where(~compression_langid.held_out()))
    assert [lang for lang, _ in learned] == ["en", "fr"]
    found = compression_langid.identify(documents, learned)
    assert found.columns[:len(documents.columns)] == documents.columns
    rows = found.collect()
    assert all(0 <= r.lang_score <= 1 for r in rows)
    blank = [r for r in rows if not r.text or not re.search(r"[^\W\d_]", r.text)]
    assert len(blank) == 3 and all(r.lang_pred == "und" and r.lang_rejected for r in blank)
    # Not those with a passage of the other language.
    known = [r for r in rows if r.lang and r.text and len(r.text) > 100 and r.doc_id != 306 and "\n" not in r.text]
    wrong = [(r.doc_id, r.lang, r.lang_pred) for r in known if r.lang != r.lang_pred]
    assert len(wrong) <= 0.02 * len(known), wrong
    kept = compression_langid.keep_known(documents)
    assert kept.columns == documents.columns and kept.count() >= len(known)
    assert compression_langid.keep_known(no_documents).count() == 0
    assert compression_langid.learn(no_documents) == []


@pytest.mark.parametrize("letters", ["bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz"])
def test_letters_of_no_language_are_rejected(spark, letters):
    """Random letters of any length are rejected, held-out texts of the languages are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    compressors = compression_langid.Compressors(compression_langid.learn(docs.where(~compression_langid.held_out())))
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)) for n in (10, 40, 150, 600) for _ in range(50)]
    junk += [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(4000)) for _ in range(3)]
    assert sum(not compressors.decide(t)[2] for t in junk) < 0.05 * len(junk)
    clean = [r.text for r in docs.where(compression_langid.held_out() & F.col("lang").isNotNull() & (F.length("text") >= 100)).collect()]
    assert len(clean) > 100 and sum(compressors.decide(t)[2] for t in clean) <= 0.01 * len(clean)


def test_language_sample_is_bounded(spark, documents):
    """One id many times is one document of the sample; the plan broadcasts nothing by force."""
    one = documents.where("doc_id = 5").crossJoin(spark.range(600)).drop("id")
    labelled = documents.where("lang is not null and text is not null and doc_id is not null")
    assert compression_langid.learn(labelled.unionByName(one.select(*labelled.columns)), sample_docs=400) == sorted(
        compression_langid.learn(labelled, sample_docs=400), key=lambda x: x[0] != one.first().lang)
    for lang, content in compression_langid.learn(labelled, size=1000):
        assert lang in ("en", "fr")
        assert 0 < len(content) <= 1000
    assert [lang for lang, _ in compression_langid.learn(labelled, languages=1)] == ["en"]


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(rng.integers(1, 8))])
        phrases = rng.integers(1, 4, (20, 3))
        which, at = FmIndex(text, 3).search(phrases)
        assert sorted(zip(which.tolist(), at.tolist())) == sorted(
            (i, j) for i, p in enumerate(phrases) for j in range(len(text) - 2) if (text[j:j + 3] == p).all())


def brute_hits(text, items, size=10):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        v = words(body)
        n = min(size, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def benchmark(spark, documents):
    texts = {r.doc_id: r.text for r in documents.where("doc_id is not null").collect()}
    items = [(1, " ".join(texts[4].split(" ")[5:40])), (2, texts[7].upper()), (3, "one two"), (4, None), (5, ""),
             (2, texts[7]), (10, "never seen " * 12)]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_contamination_equals_brute_force(documents, benchmark, slice_bytes):
    table, items = benchmark
    got = decontaminate.contamination(documents, table, slice_bytes=slice_bytes).collect()
    expected = Counter((r.doc_id, *map(str, brute_hits(r.text, items))) for r in documents.collect())
    assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == expected


def test_removed_passages_are_gone(spark, documents, no_documents, benchmark):
    table, items = benchmark
    before = {r.doc_id: r for r in documents.collect() if r.doc_id != 0}
    clean = decontaminate.remove_passages(documents, table)
    assert clean.columns == documents.columns
    after = {r.doc_id: r for r in clean.collect()}
    for key, r in before.items():
        n, hit, _ = brute_hits(r.text, items)
        assert (key in after) == (n == 0 or hit < n)
        if key in after:
            assert len(words(after[key].text)) == n - hit
            assert hit or after[key] == r
            assert not hit or after[key].n_chars == len(after[key].text)
    assert decontaminate.remove_passages(no_documents, table).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents, nothing).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_recursive_model(documents, no_documents, order):
    tokens = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW)) + [None]) for r in documents.collect()]
    counts = Counter()
    for key, t in tokens:
        if key is not None and zlib.crc32(str(key).encode()) % 10:
            counts.update(tuple(t[i:i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (total + 0.1 * (distinct + 1))
        return (counts[gram] + 50 * p(gram[1:])) / (counts[gram[:-1]] + 50)

    expected = sorted((
        -1 if key is None else key, len(t), sum((w,) in counts for w in t), total,
        round(sum(math.log10(p((w,))) for w in t), 6),
        round(sum(math.log10(p(tuple(t[max(0, i - order + 1):i + 1]))) for i in range(len(t))), 6)) for key, t in tokens)
    rows = backoff_lm.score(documents, order=order, mass=50.0, shard_bytes=20_000).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6),
                  round(r.score, 6)) for r in rows)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5)
    assert backoff_lm.score(no_documents).count() == 0


def brute_patterns(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and doubled % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_patterns_equal_plain_expressions():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ0123459._%+-@@ ()\n,é") for _ in range(rng.randint(0, 40)))
        assert pii.patterns(text) == brute_patterns(text)


def test_tagger_learns_its_table_and_leaves_plain_numbers_alone():
    model = pii.learn()
    texts = ["ring (212) 555-0147 now", "visa 4111 1111 1111 1111", "in 1999 about 12 of 400 were 3.5 m", "on 2021-05-06 at 10:30"]
    found = pii.tagged(pa.array(texts), model)
    assert [(texts[0][b:e], pii.KINDS[k]) for b, k, e in found[0]] == [("(212) 555-0147", "phone")]
    assert 1 in found and 2 not in found and 3 not in found


def test_tagger_finds_what_the_patterns_miss():
    """On rows it never learned from; base spans stay."""
    model = pii.learn()
    found = pii.quality(model)
    assert found["patterns_recall"] < 0.2 and found["recall"] > 0.8 and found["precision"] > 0.9
    texts = ["mail müller@exämple.de now", "ref 555-0100", "tel 030 1234567", "card 4111.1111.1111.1111 used", "on page 030 1234567 words", None, ""]
    base, every = pii._found(pa.array(texts), model)
    assert not any(base)
    assert [[(pii.KINDS[k], t[b:e]) for b, k, e in row] for t, row in zip(texts, every)] == [
        [("email", "müller@exämple.de")], [("phone", "555-0100")], [("phone", "030 1234567")], [("card", "4111.1111.1111.1111")], [], [], []]


def test_personal_data_of_a_table_with_the_same_names(spark, documents):
    table = documents.limit(5).withColumn("pii_base", F.lit(1)).withColumn("pii_spans", F.lit("x"))
    found = pii.find_personal_data(table)
    assert found.columns == [*table.columns, "pii_base_", "pii_spans_"] and found.count() == 5


def test_viterbi_equals_all_paths():
    import itertools
    rng = np.random.default_rng(1)
    from emberline.llm.crf import Crf
    model = Crf(np.arange(6, dtype=np.uint64), np.vstack([rng.normal(size=(6, 3)), np.zeros(3)]), rng.normal(size=(3, 3)), rng.normal(size=3))
    length = np.array([4, 1, 3])
    features = rng.integers(0, 8, (8, 2)).astype(np.uint64)
    got, at = model.decode(features, length), 0
    emission = model.emission(features)
    for n in length:
        def value(path):
            return model.first[path[0]] + sum(emission[at + i, x] for i, x in enumerate(path)) + sum(
                model.step[a, b] for a, b in zip(path, path[1:]))
        assert tuple(got[at:at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n


def test_redaction_keeps_rows_and_columns(spark, documents, no_documents):
    extra = documents.limit(3).withColumn("text", F.lit("écrit à a.b@c.de ou +1 (212) 555-0147, ip 10.0.0.1"))
    rows = pii.redact(extra).collect()
    assert {r.text for r in rows} == {"écrit à [EMAIL] ou [PHONE], ip [IP]"} and rows[0].n_chars == len(rows[0].text)
    same = pii.redact(documents)
    assert same.columns == documents.columns and same.count() == documents.count()
    assert pii.redact(no_documents).count() == 0


def test_token_counts_equal_the_library(documents, no_documents):
    sentencepiece = pytest.importorskip("sentencepiece")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = bpe_count.BpeCounter(path)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\tabcdeftheing▁é日本😀<0xA>s/unk_ 　\x00\xa0") for _ in range(rng.randint(0, 40)))
        assert counter.count(text) == len(library.encode(text))
    for r in bpe_count.token_counts(documents, path).join(documents, "doc_id").collect():
        assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 4096)
    assert bpe_count.token_counts(no_documents, path).count() == 0
