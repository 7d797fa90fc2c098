"""Personal data in texts: fixed patterns, and a conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card numbers (14 to 19 digits, Luhn) and phone
numbers (+, 10 to 15 digits); their matches always stay. The tagger adds what no pattern covers,
such as phone numbers without a plus sign, addresses of letters beyond ASCII, IPv6 and cards in
groups by dots. Its quality on rows it never learned from is ``quality()``.

The tagger is a linear-chain conditional random field over tokens between blanks. Only tokens with
a digit or an @ can be part of personal data, all others are outside by definition; so a text falls
into runs of such tokens within a line, and the best labels of each run are independent of the
rest. Features are hashes of the shapes (runs of upper, lower, digits; other characters as they
are) and digit counts of a token and its neighbours and the word before. The field is trained by
the driver from a small labelled table and reaches the tasks as a few arrays of its size.

An added span is kept if it does not touch a pattern's span and holds what its kind requires: an @
between a name and a host of any letters, an address of version 4 or 6, 13 to 19 digits passing
Luhn (in groups by dots, slashes, too), or 7 to 15 digits in at least two groups.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; positions
are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.crf import Crf, train
from emberline.llm.pii_labels import HELD_OUT, LABELLED
from emberline.llm.words import SPACED_BYTES, U64, by_bytes, find_words, light_batches, mix, spans_hash, text_bytes, unused

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = text.find("@", done if domain else at + 1)


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind number, end) of every match of the fixed patterns, in order."""
    found = []
    if "@" in text:
        found += [(b, 0, e) for b, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].translate(_NO_DIGIT)
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(_NO_DIGIT)) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _shape_table() -> np.ndarray:
    """Byte to shape class: upper, lower and further letters, digits; others are themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] = 0x58
    table[0x61:0x7B] = 0x78
    table[0x80:] = 0x78
    table[0x30:0x3A] = 0x64
    return table


_SHAPES = _shape_table()
# Coarser: letters and digits alike.
_OUTLINES = np.where(np.isin(_SHAPES, [0x58, 0x64]), 0x78, _SHAPES).astype(np.uint8)


def candidate_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that may be personal data, in runs: (byte begin, byte end, features, run lengths)."""
    data, offsets = text_bytes(column)
    words = find_words(column, SPACED_BYTES)
    n = len(words.begin)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros((0, 0), U64), empty

    def count(mask: np.ndarray) -> np.ndarray:
        before = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=before[1:])
        return before

    digit = count((data >= 0x30) & (data <= 0x39))
    digits = digit[words.end] - digit[words.begin]
    at = count(data == 0x40)
    chosen = np.flatnonzero((digits > 0) | (at[words.end] > at[words.begin]))
    # Shapes of the chosen tokens and their neighbours, from the bytes of all: each run of a class once.
    doc = words.doc()

    def runs_hash(classes: np.ndarray) -> np.ndarray:
        of = classes[data]
        change = np.ones(len(data), bool)
        change[1:] = of[1:] != of[:-1]
        change[words.begin] = True
        kept = count(change)
        return spans_hash(mix(of[change].astype(U64)), kept[words.begin], kept[words.end])

    shape, outline = runs_hash(_SHAPES), runs_hash(_OUTLINES)
    before, after = np.maximum(chosen - 1, 0), np.minimum(chosen + 1, n - 1)
    lines = count(data == 0x0A)
    line = lines[words.begin]
    joined_before = (chosen > 0) & (doc[before] == doc[chosen]) & (line[before] == line[chosen])
    joined_after = (chosen < n - 1) & (doc[after] == doc[chosen]) & (line[after] == line[chosen])
    none = U64(1)
    few = np.minimum(digits, 20).astype(U64)
    values = [
        np.zeros(len(chosen), U64), shape[chosen], np.where(joined_before, shape[before], none),
        np.where(joined_after, shape[after], none), few[chosen], np.where(joined_before, few[before], U64(99)),
        np.where(joined_after, few[after], U64(99)), np.where(joined_before, words.hash[before], none),
        mix(shape[chosen]) + np.where(joined_after, shape[after], none),
        mix(shape[chosen]) + np.where(joined_before, shape[before], none),
        outline[chosen], mix(outline[chosen]) + few[chosen],
    ]
    features = np.stack([mix(mix(v) + U64(i)) for i, v in enumerate(values)], 1)
    starts = np.ones(len(chosen), bool)
    starts[1:] = (chosen[1:] != chosen[:-1] + 1) | ~joined_before[1:]
    return words.begin[chosen], words.end[chosen], features, np.diff(np.append(np.flatnonzero(starts), len(chosen)))


def unmarked(labelled: list[str]) -> tuple[list[str], list[list[tuple[int, str, int]]]]:
    """The texts of a labelled table, and the spans (begin, kind, end) in code points that it marks."""
    texts, marks = [], []
    for row in labelled:
        text, spans = "", []
        for plain, kind, span in re.findall(r"([^{]*)(?:\{(\w+)\|([^}]*)\})?", row):
            text += plain
            if kind:
                spans.append((len(text), kind, len(text + span)))
                text += span
        texts.append(text)
        marks.append(spans)
    return texts, marks


def learn(labelled: list[str] | None = None) -> Crf:
    """The tagger, from texts in which {kind|span} marks personal data."""
    texts, marks = unmarked(labelled or LABELLED)
    column = pa.array(texts)
    _, offsets = text_bytes(column)
    begin, end, features, length = candidate_runs(column)
    labels = np.zeros(len(begin), np.int64)
    for row, spans in enumerate(marks):
        for low, kind, high in spans:
            low, high = (len(texts[row][:x].encode()) for x in (low, high))
            inside = np.flatnonzero((begin < offsets[row] + high) & (end > offsets[row] + low))
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[:1]] = LABELS.index(f"B-{kind}")
    allowed = np.array([[b[0] != "I" or (a != "O" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])
    return train(features, labels, length, allowed, np.array([x[0] != "I" for x in LABELS]))


def _address(span: str) -> bool:
    try:
        return bool(ipaddress.ip_address(span))
    except ValueError:
        return False


def _plausible(kind: int, span: str) -> bool:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        return bool(re.fullmatch(r"[^@\s]+@\w[^@\s]+", span))
    if kind == 1:
        return _address(span)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", span)
    groups = re.findall(r"[0-9]+", span)
    return (7 <= len(digits) <= 15 and len(groups) >= 2 and not re.search(r"[^0-9 ()./+-]", span)
            and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+/[0-9]+/[0-9]+", span))


def _trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and not (text[begin].isalnum() or text[begin] in "+("):
        begin += 1
    while begin < end and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def tagged(column: pa.Array, model: Crf) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (begin, kind, end) in code points that the tagger finds, by row."""
    begin, end, features, length = candidate_runs(column)
    if not len(begin):
        return {}
    label = model.decode(features, length)
    head = np.zeros(len(begin), bool)
    head[np.cumsum(length) - length] = True
    data, offsets = text_bytes(column)
    inside = label > 0
    opens = np.flatnonzero(inside & (label % 2 == 1))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i in opens:
        j = i
        while j + 1 < len(label) and not head[j + 1] and label[j + 1] == label[i] + 1:
            j += 1
        row = int(np.searchsorted(offsets, begin[i], "right")) - 1
        low = len(data[offsets[row]:begin[i]].tobytes().decode())
        span = data[begin[i]:end[j]].tobytes().decode()
        a, b = _trimmed(span, 0, len(span))
        kind = (int(label[i]) - 1) // 2
        if _plausible(kind, span[a:b]):
            found.setdefault(row, []).append((low + a, kind, low + b))
    return found


def _found(text: pa.Array, model: Crf) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Per text: spans of the patterns, and all spans."""
    base = [patterns(t) if t else [] for t in text.to_pylist()]
    every = list(base)
    for row, more in tagged(text, model).items():
        free = [s for s in more if all(s[2] <= b or s[0] >= e for b, _, e in base[row])]
        every[row] = sorted({*base[row], *free})
    return base, every


def quality(model: Crf | None = None, held_out: list[str] | None = None) -> dict[str, float]:
    """Precision and recall of all spans, and recall of the patterns alone, on held-out labelled rows."""
    texts, marks = unmarked(held_out or HELD_OUT)
    base, every = _found(pa.array(texts), model or learn())
    wanted, got, plain = ({(i, b, KINDS[k] if isinstance(k, int) else k, e) for i, row in enumerate(rows) for b, k, e in row}
                          for rows in (marks, every, base))
    return {"precision": len(got & wanted) / max(1, len(got)), "recall": len(got & wanted) / max(1, len(wanted)),
            "patterns_recall": len(plain & wanted) / max(1, len(wanted))}


def find_personal_data(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with pii_base and pii_spans: arrays of (begin, kind, end), in order.

    Where ``docs`` has columns of these names, underscores are added to the new ones.
    """
    model = model or learn()
    at, names = docs.columns.index("text"), [unused(n, docs) for n in ("pii_base", "pii_spans")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in by_bytes(batches):
            named = [pa.array([[{"begin": b, "kind": KINDS[k], "end": e} for b, k, e in row] for row in rows], kind)
                     for rows in _found(batch.column(at), model)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *named], names=[*batch.schema.names, *names])

    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("kind", T.StringType()),
                                     T.StructField("end", T.LongType())]))
    return light_batches(docs).mapInArrow(scan, T.StructType(
        [*docs.schema.fields, *(T.StructField(n, span) for n in names)]))


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; n_chars follows if there.

    Spans that overlap become one, named after the first.
    """
    model = model or learn()
    at, hit_name = docs.columns.index("text"), unused("pii_hit", docs)

    def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for begin, kind, end in spans:
            if begin >= done:
                out += [text[done:begin], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return "".join(out) + text[done:]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            text = batch.column(at)
            _, every = _found(text, model)
            hit = [bool(s) for s in every]
            if any(hit):
                text = pa.array([masked(t, s) if s else t for t, s in zip(text.to_pylist(), every)], pa.string())
            columns = [text if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hit)], names=[*batch.schema.names, hit_name])

    out = light_batches(docs).mapInArrow(replace, T.StructType([*docs.schema.fields, T.StructField(hit_name, T.BooleanType())]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(hit_name), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
