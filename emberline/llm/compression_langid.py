"""Language of a text by compression: the language whose dictionary makes it smallest.

For each language a zstandard raw-content dictionary is filled with lines of its labelled texts. A
text is lower-cased, its ASCII characters that are no letters become single spaces, and it is cut
into blocks of ``BLOCK`` bytes (in a longer one the text's own repeats outweigh the dictionary).
Every block of the whole text is compressed with each dictionary. The smallest sum wins.

The score is the margin between the best and the second-best language, 1 - best / second, where
both sums are taken net of what an empty block costs; it lies between 0 and 1. A text is rejected
if it has no letter (``und``, score 0), a margin under ``MARGIN``, or, where no dictionary explains
it, a margin that chance gives as well: sizes of n bytes of noise differ by a few times the root of
n, so a text whose best share of its bytes is over ``SHARE`` + ``SHORT`` / sqrt(n) needs a margin of
``NOISE`` / sqrt(n), ``NOISE_FLOOR`` at least. Texts that a dictionary does explain, as those in two languages, need ``MARGIN``.

Fitting uses a bounded sample: at most ``SAMPLE_DOCS`` different labelled documents of each language,
those of the smallest hash of the id, and the ``MOST_LANGUAGES`` languages with most documents; the
dictionaries hold ``DICTIONARY_BYTES`` of their lines, taken in hash order. The sample is chosen and
cut to that size in the plan: a share of the hash range, from an estimate of the different documents
of each language, is all that is shuffled, and the driver receives the dictionaries. Predictions
read the text alone.

Defined cases: null texts and texts without letters are ``und`` and rejected; ties go to the
language with more labelled documents, then the smaller name; labels that are null are not learned
from; rows that repeat an id are one document of the sample, with the smallest of their texts;
without any labelled text every prediction is ``und``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from emberline.llm.words import light_batches, unused

UNKNOWN = "und"
SAMPLE_DOCS = 400
MOST_LANGUAGES = 256
# A dictionary is cut to this size from whole lines of the sample.
DICTIONARY_BYTES = 96 << 10
BLOCK = 1 << 10
# Lower levels look up too few places of a dictionary to tell languages apart.
LEVEL = 5
MARGIN = 0.002
# Of texts of a learned language 99.5 % shrink below this share of their n bytes, random letters never do.
SHARE, SHORT = 0.47, 2.0
# About the widest margin of random letters, times the root of their bytes.
NOISE = 0.7
# Dictionaries differ a little for noise of any length.
NOISE_FLOOR = 0.015
_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = {c: " " for c in range(128) if not chr(c).isalpha()}


def letters(text: str) -> str:
    return " ".join(text.lower().translate(_BLANKS).split())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, line, place): the different lines of each text in letters, with their place by hash."""
    for batch in batches:
        rows = [(lang, line) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for line in {letters(part) for part in text.split("\n")} - {""}]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([zlib.crc32(r[1].encode()) for r in rows], pa.int64())], names=["lang", "line", "place"])


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES,
          languages: int = MOST_LANGUAGES) -> list[tuple[str, bytes]]:
    """(language, dictionary) from rows (doc_id, text, lang), languages with more rows first."""
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), hashed.alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(
        F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return []
    # Four times the share of the hash range that the sample needs.
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 4.0 * sample_docs / max(1, r.different)))])
    share = (F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64
    near = rows.where(share <= F.try_element_at(bounds, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = near.withColumn("n", rank).where(F.col("n") <= sample_docs).select("lang", "text")
    lines = light_batches(sample).mapInArrow(_lines, "lang string, line string, place long").distinct()
    before = Window.partitionBy("lang").orderBy("place", "line").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0))
    # Of a line that is longer than the dictionary only its beginning can be in it.
    taken = lines.withColumn("filled", filled).where(F.col("filled") < size).select("lang", "place", F.left("line", F.lit(size)).alias("line"))
    content: dict[str, list] = {}
    for r in taken.collect():
        content.setdefault(r.lang, []).append((r.place, r.line))
    return [(r.lang, b"".join(line.encode() + b" " for _, line in sorted(content[r.lang]))[:size]) for r in counts if r.lang in content]


class Compressors:
    """One compressor per language, and the sizes they make of texts."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.languages = [lang for lang, _ in dictionaries]
        self.each = []
        for _, content in dictionaries:
            content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(
                dict_data=content, level=LEVEL, write_checksum=False, write_dict_id=False))
        self.empty = [len(c.compress(b"")) for c in self.each]

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(map(len, map(c.compress, blocks))) - e * len(blocks) for c, e in zip(self.each, self.empty)]

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not _LETTER.search(text) or not self.each:
            return UNKNOWN, 0.0, True
        plain = letters(text).encode("utf-8", "replace")
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = min(1.0, max(0.0, 1 - sizes[best] / second)) if second > 0 else 0.0
        root = math.sqrt(len(plain))
        explained = sizes[best] <= (SHARE + SHORT / root) * len(plain)
        return self.languages[best], score, score < (MARGIN if explained else max(NOISE_FLOOR, NOISE / root))


RESULT = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], names: tuple[str, str, str] = RESULT) -> DataFrame:
    """``docs`` with the columns ``names``: language, score, rejected; from ``text`` alone."""
    at = docs.columns.index("text")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries)
        for batch in batches:
            found = [compressors.decide(text.as_py()) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array(np.array([f[1] for f in found], np.float64)), pa.array([f[2] for f in found], pa.bool_())],
                names=[*batch.schema.names, *names])

    schema = T.StructType([
        *docs.schema.fields, T.StructField(names[0], T.StringType()),
        T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return light_batches(docs).mapInArrow(classify, schema)


def held_out() -> Column:
    """Whether a document of ``doc_id`` is kept out of learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected; labels are those of ``docs``."""
    names = tuple(unused(n, docs) for n in RESULT)
    found = identify(docs, learn(docs.where(~held_out())), names)
    return found.where(~F.col(names[2])).select(*docs.columns)
