"""Exact duplicates of a stream: the first row of each key, for ever.

The keys seen so far are keyed state in RocksDB, without watermark or expiry, so a repeat is found
after months as well; a micro-batch looks up its own keys only and never reads what is stored.
Rows are dealt by a hash of the key into buckets, the groups of the stateful operator, so a task
holds a share of the keys whatever devices they belong to. A bucket's keys lie in pages by their hash,
of bounded size however many there are: a state call costs far more than a look at a page, and a
micro-batch makes a few calls per page instead of several per key. Of a key that a micro-batch brings
more than once the row of the smallest ``arrival`` counts. A task holds the new rows of a bucket, at most
one of each key and as many again: the size of a micro-batch (files per trigger, of bounded size) bounds it.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The number of groups of the keyed state; it must stay the same as long as a checkpoint is used.
BUCKETS = 256
# So many rows are passed on at a time.
CHUNK = 10_000
# So many rows are gathered before their keys are looked up.
ASK = 50_000
# Keys of a page, on average, and of a page's smallest runs.
PAGE, RUN = 2_000, 16


def in_arrival_order(lines: DataFrame) -> DataFrame:
    """Add ``arrival`` to a file stream: a text that sorts by file time, file and place in the file.

    The place is counted while a split is read, in its order, so a retried batch gives the same.
    """
    meta = F.col("_metadata")
    split = F.concat_ws(
        "\x01", F.lpad(F.unix_micros(meta["file_modification_time"]).cast("string"), 20, "0"), meta["file_path"],
        F.lpad(meta["file_block_start"].cast("string"), 20, "0"))
    placed = lines.select("*", split.alias("arrival"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            numbers = pa.array([f"\x01{n:020d}" for n in range(at, at + batch.num_rows)], pa.string())
            at += batch.num_rows
            arrival = [None if split is None else split + n for split, n in zip(
                batch.column(batch.num_columns - 1).to_pylist(), numbers.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(arrival, pa.string())], names=batch.schema.names)

    return placed.mapInArrow(count, placed.schema)


class Pages:
    """A set of texts in a map state (page, run -> keys as a JSON list), in pages of bounded size.

    Pages are split one after the other as the set grows (linear hashing), so a key's page follows
    from its hash and the number of pages. A page is a few runs of sizes that double: new keys become
    a run, and runs of one size are merged, so a key is written anew a logarithmic number of times
    only. The entry ``DIRECTORY`` holds the number of keys and, as bits, the runs of each page.
    """

    DIRECTORY = (-1, 0)

    def __init__(self, state) -> None:
        self.state = state

    def which(self, names: Iterable[str]) -> set[str]:
        """Those of ``names`` that are in the set; one page is held at a time."""
        _, runs = self._directory()
        found: set[str] = set()
        for page, some in self._by_page(names, len(runs)).items():
            for run in self._runs(runs[page]):
                found.update(set(some).intersection(self._read(page, run)))
        return found

    def add(self, names: Iterable[str]) -> None:
        """Put in different texts that are not in the set."""
        names = list(names)
        count, runs = self._directory()
        count += len(names)
        while count > PAGE * len(runs):
            self._split(runs)
        for page, some in self._by_page(names, len(runs)).items():
            self._put(runs, page, some)
        self.state.updateValue(self.DIRECTORY, (json.dumps([count, runs]),))

    def _directory(self) -> tuple[int, list[int]]:
        if not self.state.containsKey(self.DIRECTORY):
            return 0, [0]
        count, runs = json.loads(self.state.getValue(self.DIRECTORY)[0])
        return count, runs

    @staticmethod
    def _page(name: str, pages: int) -> int:
        half = 1 << (pages.bit_length() - 1)
        page = crc32(name.encode()) % (2 * half)
        return page if page < pages else page - half

    def _by_page(self, names: Iterable[str], pages: int) -> dict[int, list[str]]:
        out = defaultdict(list)
        for name in names:
            out[self._page(name, pages)].append(name)
        return out

    @staticmethod
    def _runs(bits: int) -> list[int]:
        return [run for run in range(bits.bit_length()) if bits >> run & 1]

    def _read(self, page: int, run: int) -> list[str]:
        return json.loads(self.state.getValue((page, run))[0])

    def _put(self, runs: list[int], page: int, keys: list[str]) -> None:
        """A new run of a page, merged with those of its size."""
        run = (len(keys) // RUN).bit_length()
        while runs[page] >> run & 1:
            keys = self._read(page, run) + keys
            runs[page] ^= 1 << run
            larger = (len(keys) // RUN).bit_length()
            if larger != run:
                self.state.removeKey((page, run))
            run = larger
        runs[page] |= 1 << run
        self.state.updateValue((page, run), (json.dumps(keys, ensure_ascii=False),))

    def _split(self, runs: list[int]) -> None:
        """One page more: it takes its keys from the page that comes next in turn."""
        old = len(runs) - (1 << (len(runs).bit_length() - 1))
        keys = []
        for run in self._runs(runs[old]):
            keys += self._read(old, run)
            self.state.removeKey((old, run))
        runs[old] = 0
        runs.append(0)
        for page, some in self._by_page(keys, len(runs)).items():
            self._put(runs, page, some)


class FirstOfKey(StatefulProcessor):
    """Passes on the first row of each key; rows without a key all pass."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = Pages(handle.getMapState("pages", "page bigint, run bigint", "keys string"))

    def _stored(self, names: list[str]) -> set[str]:
        if isinstance(self.seen, Pages):
            return self.seen.which(names)
        return {name for name in names if self.seen.containsKey((name,))}

    def _store(self, names: Iterable[str]) -> None:
        if isinstance(self.seen, Pages):
            self.seen.add(names)
        else:
            for name in names:
                self.seen.updateValue((name,), (True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known: dict[str, bool] = {}
        held, count, tidy = [], 0, 0
        waiting: list[pd.DataFrame] = []

        def firsts() -> pd.DataFrame:
            return pd.concat(held).sort_values("arrival", kind="stable").drop_duplicates(self.key)

        def hold() -> None:
            """Of the waiting rows hold those of no stored key."""
            nonlocal held, count, tidy
            if not waiting:
                return
            chunk = pd.concat(waiting)
            waiting.clear()
            names = [name for name in dict.fromkeys(chunk[self.key]) if name not in known]
            stored = self._stored(names)
            known.update((name, name in stored) for name in names)
            chunk = chunk[[not known[name] for name in chunk[self.key]]]
            if not len(chunk):
                return
            held.append(chunk)
            count += len(chunk)
            if count > 2 * tidy + CHUNK:  # so that every row is sorted a few times only
                held = [firsts()]
                count = tidy = len(held[0])

        for chunk in rows:
            keyed = chunk[self.key].notna()
            if not keyed.all():
                yield chunk[~keyed]
            chunk = chunk[keyed]
            if len(chunk):
                waiting.append(chunk)
            if sum(map(len, waiting)) >= ASK:
                hold()
        hold()
        if not held:
            return
        first = firsts()
        held.clear()
        self._store(first[self.key])
        for at in range(0, len(first), CHUNK):
            yield first[at:at + CHUNK]


def first_of_key(stream: DataFrame, key: str = "message_key", buckets: int = BUCKETS) -> DataFrame:
    """The rows of a stream of texts and doubles (with ``arrival``) whose key has not been seen before."""
    if odd := [f.name for f in stream.schema if not isinstance(f.dataType, (T.StringType, T.DoubleType))]:
        raise ValueError(f"whole numbers would lose their nulls or digits on the way: {odd}")
    bucket: Column = F.pmod(F.xxhash64(F.coalesce(F.col(key), F.col("arrival"))), F.lit(buckets))
    dealt = stream.withColumn("_bucket", bucket)
    return dealt.groupBy("_bucket").transformWithStateInPandas(
        FirstOfKey(key), outputStructType=stream.schema, outputMode="Append", timeMode="None")
