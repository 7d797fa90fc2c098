"""Number of tokens of a text under a sentencepiece BPE model, by heap and linked list.

The text is blank-escaped and prefixed as the model's normaliser says and split into characters.
Adjacent pairs whose concatenation is a piece wait in a heap by the piece's rank (score, then
position); the lowest is popped and merged, its neighbours in the linked list form new pairs. The
count is the number of initial symbols minus the merges, plus the further bytes of characters that
are no piece (byte fallback). No identifiers are made.

No piece of such a model continues after an inner blank, so merges never cross from a word into the
blanks before the next one; the constructor checks that. Words are counted once per worker and
kept in a table of at most ``KEPT`` entries; longer words than ``KEPT_CHARS`` are not kept.

Defined cases: null and empty texts have 0 tokens; blanks are kept as they are; text that looks
like a special token is ordinary text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from emberline.llm.words import light_batches

LIMIT = 4096
KEPT, KEPT_CHARS = 600_000, 40
BLANK = "▁"


class BpeCounter:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        usable = [i for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        # Rank: higher scores first.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in usable}
        self.bytes_of_unknown = any(model.is_byte(i) for i in ids)
        several = [p for p in self.rank if len(p) > 1]
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in several):
            raise ValueError("a piece continues after an inner blank; words can't be counted one by one")
        # A line break that no longer piece contains is a word of its own.
        self.breaks = not any("\n" in p for p in several)
        self.kept: dict[str, int] = {"": 0}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if text[0] == " " or "  " in text or BLANK in text or not self.breaks:
            escaped = BLANK + text.replace(" ", BLANK)
            words = re.findall(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if self.breaks else f"{BLANK}*[^{BLANK}]+|{BLANK}+", escaped)
            return sum(map(self.word, words))
        breaks = text.count("\n")
        words = (BLANK + text.replace(" ", f" {BLANK}").replace("\n", " ")).split(" ")
        kept = self.kept
        total = breaks * self.word("\n") if breaks else 0
        for word in words:
            n = kept.get(word)
            total += self.word(word) if n is None else n
        return total

    def word(self, word: str) -> int:
        n = self.kept.get(word)
        if n is None:
            n = self._merged(word)
            if len(word) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.kept = {"": 0}
                self.kept[word] = n
        return n

    def _merged(self, word: str) -> int:
        rank = self.rank
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = word[i:i + 2]
            r = rank.get(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or len(left) >= len(pair):
                continue
            j = after[i]
            # The pair may be gone: one of its sides was merged meanwhile.
            if j >= n or len(left) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = pair + symbols[k]
                r = rank.get(right)
                if r is not None:
                    heapq.heappush(heap, (r, i, right))
            h = before[i]
            if h >= 0:
                joined = symbols[h] + pair
                r = rank.get(joined)
                if r is not None:
                    heapq.heappush(heap, (r, h, joined))
        extra = 0
        if self.bytes_of_unknown:
            extra = sum(len(s.encode("utf-8", "replace")) - 1 for s in symbols if s and len(s) == 1 and s not in rank)
        return n - merges + extra


_COUNTERS: dict[str, BpeCounter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; ``model_path`` is a file on every machine."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker's counter, and with it its table of words, serves its later tasks too.
        counter = _COUNTERS.setdefault(model_path, None) or BpeCounter(model_path)
        _COUNTERS[model_path] = counter
        for batch in batches:
            tokens = np.fromiter((counter.count(t.as_py()) for t in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    return light_batches(docs).select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"),
    ).mapInArrow(tally, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
