"""Rates and sessions of a readings stream, as the readings arrive.

Each reading gets its rates from all readings of its window that have arrived by then, however late
it or they are, and earlier ones are never revised. The detector is the set/reset latch of the batch
form; it ignores readings that are not newer than all before. Where batches begin and end makes no
difference. The batch operators recompute everything in event-time order.

The state of a device is bounded: its latch, and its readings in blocks of one window length, as far
back as the window and the run of start samples of its newest reading can reach. Older blocks are
dropped, their readings are in the stored table. Few readings are kept beside the latch, so such a device
costs two state calls a micro-batch; those of a device that sends much are kept block by block. Devices are
dealt into lanes, the groups of the operator, and the rates of a lane's devices are made side by side. A reading that comes so late that it would need a
dropped block is passed on without rates, marked ``late``; ``late_rates`` makes them from the stored
readings, in one job for all late readings of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.config import MINUTE_MS, RuntimeConfig
from emberline.operators.slices import number_of
from emberline.streaming.keys import BUCKETS

# A block's readings in order of arrival: rows of time, air, heater and heater rate as doubles.
BLOCK = "rows binary"
LATCH = ("seen bigint, run_start bigint, run_length int, warm bigint, opened bigint, hot bigint, air double, "
         "heater double, rate double, rows bigint, lowest bigint, near binary")
SESSION = ("started_at_ms bigint, ended_at_ms bigint, last_hot_at_ms bigint, peak_sauna_c double, "
           "peak_stovepipe_c double, max_stovepipe_rate_c_per_min double, sample_count bigint")
OUTPUT = ("device_id string, message_key string, arrival string, payload string, observed_at_ms bigint, late boolean, "
          f"sauna_rate_c_per_min double, stovepipe_rate_c_per_min double, {SESSION}")
NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
TIME, AIR, HEATER, RATE = range(4)
# So many window rows are looked at in one step of the vectorised rates.
AT_ONCE = 1 << 18
# Up to so many bytes of readings (32 each) are kept beside a device's latch.
NEAR = 1 << 16


@dataclass
class Latch:
    """What the detector knows of a device; ``run`` is the current row of hot readings."""
    seen: int | None = None
    run_start: int | None = None
    run_length: int = 0
    warm: int | None = None
    opened: int | None = None
    hot: int | None = None
    air: float | None = None
    heater: float | None = None
    rate: float | None = None
    rows: int = 0
    lowest: int | None = None  # the oldest block that is kept
    near: bytes | None = b""  # the readings in reach, None if they are kept in blocks

    def advance(self, cfg: RuntimeConfig, now: int, heater: float, reading: np.ndarray, since) -> tuple | None:
        """Take one reading; ``since(t)`` are the readings from ``t`` to now.  Returns its session."""
        if self.seen is not None and now <= self.seen:
            return None
        joined = self.run_length > 0 and now - self.seen <= cfg.max_gap_ms
        self.seen = now
        if heater >= cfg.start_c:
            self.run_start, self.run_length = (self.run_start, self.run_length + 1) if joined else (now, 1)
        else:
            self.run_start, self.run_length = None, 0
        sets = self.run_length == cfg.start_samples
        resets = heater < cfg.end_c and (self.warm is None or now - self.warm >= cfg.hold_ms)
        if heater >= cfg.end_c:
            self.warm = now
        if self.opened is None:
            if not sets:
                return None
            self.opened, self.rows = self.run_start, 0
            self.air = self.heater = self.rate = None
            news = since(self.run_start)
        else:
            news = reading[None, :]
        self.rows += len(news)
        self.air, self.heater, self.rate = (
            _peak(old, news[:, column]) for old, column in ((self.air, AIR), (self.heater, HEATER), (self.rate, RATE)))
        self.hot = self.warm if self.warm is not None and self.warm >= self.opened else self.hot
        session = (self.opened, self.hot if resets else None, self.hot, self.air, self.heater, self.rate, self.rows)
        if resets:
            self.opened = self.hot = None
        return session


def _peak(old: float | None, values: np.ndarray) -> float | None:
    top = np.fmax.reduce(values, initial=np.nan if old is None else old)
    return None if np.isnan(top) else float(top)


class Places:
    """Times of several groups as whole numbers that sort by group and time, for searches in all groups at once."""

    def __init__(self, group: np.ndarray, time: np.ndarray):
        self.times = np.unique(time)
        self.group = group
        self.place = self.of(group, time, "left")

    def of(self, group: np.ndarray, time: np.ndarray, side: str) -> np.ndarray:
        return group * (len(self.times) + 1) + np.searchsorted(self.times, time, side)

    def order(self) -> np.ndarray:
        """Rows by group and time, equal ones as they come; from then on ``begin`` and ``end`` can be asked."""
        order = np.argsort(self.place, kind="stable")
        self.sorted = self.place[order]
        return order

    def begin(self, group: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many rows come before the time ``low`` of a group."""
        return np.searchsorted(self.sorted, self.of(group, low, "left"), "left")

    def end(self, group: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many rows come up to the time ``high`` of a group."""
        return np.searchsorted(self.sorted, self.of(group, high, "right"), "left")


class Timeline:
    """Readings of some blocks and of a batch, by device and time; those of the batch arrive one by one."""

    def __init__(self, stored: np.ndarray, arriving: np.ndarray, stored_of: np.ndarray | None = None, arriving_of: np.ndarray | None = None):
        every = np.concatenate([stored, arriving])
        of = [np.zeros(len(rows), np.int64) if group is None else group for rows, group in ((stored, stored_of), (arriving, arriving_of))]
        self.places = Places(np.concatenate(of), every[:, TIME])
        # Stored readings came first, in their stored order.
        order = self.places.order()
        self.rows = every[order]
        self.time = self.rows[:, TIME]
        self.came = order - len(stored)  # negative: already there
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.place = place[len(stored):]
        self.of = of[1]

    def since(self, low: float, now: int) -> np.ndarray:
        """Readings from ``low`` up to the batch's reading ``now``, of those of its device that had arrived with it."""
        begin = self.places.begin(self.of[now], low)
        end = self.places.end(self.of[now], self.time[self.place[now]])
        return self.rows[begin:end][self.came[begin:end] <= now]

    def rates(self, cfg: RuntimeConfig) -> np.ndarray:
        """Both rates of every reading of the batch, NaN where there is none."""
        out = np.full((len(self.place), 2), np.nan)
        now = self.time[self.place]
        begin = self.places.begin(self.of, now - cfg.window_ms)
        size = self.places.end(self.of, now) - begin
        ends = np.cumsum(size)
        at = 0
        while at < len(out):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + AT_ONCE, "right")))
            out[at:upto] = self._rates(cfg, np.arange(at, upto), begin[at:upto], size[at:upto])
            at = upto
        return out

    def _rates(self, cfg: RuntimeConfig, which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The windows of some readings side by side: first what had arrived, then the stretch after the last gap."""
        of = np.repeat(np.arange(len(which)), size)
        row = np.arange(len(of)) + np.repeat(begin - np.cumsum(size) + size, size)
        there = self.came[row] <= which[of]
        of, row = of[there], row[there]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        time = self.time[row]
        gap = np.r_[False, (np.diff(time) > cfg.max_gap_ms) & (of[1:] == of[:-1])]
        last_gap = np.maximum.reduceat(np.where(gap, np.arange(len(of)), first[of]), first)
        there = np.arange(len(of)) >= last_gap[of]
        of, row, time = of[there], row[there], time[there]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        minutes = (time - self.time[self.place[which]][of]) / MINUTE_MS
        out = np.empty((len(which), 2))
        for side, column in enumerate((AIR, HEATER)):
            value = self.rows[row, column]
            known = np.isfinite(value)
            n = np.add.reduceat(known.astype(float), first)

            def mean(x: np.ndarray, known=known, n=n) -> np.ndarray:
                return np.add.reduceat(np.where(known, x, 0.0), first) / np.maximum(n, 1)

            x = np.where(known, minutes - mean(minutes)[of], 0.0)
            y = np.where(known, value - mean(value)[of], 0.0)
            span = (np.maximum.reduceat(np.where(known, minutes, -np.inf), first)
                    - np.minimum.reduceat(np.where(known, minutes, np.inf), first))
            spread = np.add.reduceat(x * x, first)
            sound = (n >= 3) & (span >= cfg.span_ms / MINUTE_MS) & (spread > 0)
            out[:, side] = np.where(sound, np.add.reduceat(x * y, first) / np.where(sound, spread, 1.0), np.nan)
        return out


class DeviceProcessor(StatefulProcessor):
    """State per device of a lane: its newest readings in blocks of one window, and the latch."""

    def __init__(self, cfg: RuntimeConfig) -> None:
        self.cfg = cfg
        reach_ms = max(cfg.window_ms, cfg.start_samples * cfg.max_gap_ms)
        # With the block before the earliest one in reach, so that its readings have their windows.
        self.blocks_back = -(-reach_ms // cfg.window_ms) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "device string, number bigint", BLOCK)
        self.latches = handle.getMapState("latches", "device string", LATCH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = []
        for part in rows:
            other = part["message_key"].isna()  # no reading: passed on as it is
            if other.any():
                none = part[other].assign(late=False).reindex(columns=NAMES).astype(object)
                yield none.where(none.notna(), None)
            parts.append(part[~other])
        # Arrival order is that of the whole micro-batch, whose size the trigger bounds.
        arrived = pd.concat(parts)
        if not len(arrived):
            return
        device, names = pd.factorize(arrived["device_id"], use_na_sentinel=False)
        names = [None if pd.isna(name) else name for name in names]
        order = np.lexsort((pd.factorize(arrived["arrival"], sort=True)[0], device))
        latches = []
        for name in names:
            held = self.latches.getValue((_state_key(name),))
            latches.append(Latch(*held) if held is not None else Latch())
        yield self._arrive(names, device[order], arrived.iloc[order], latches)
        for name, latch in zip(names, latches, strict=True):
            self.latches.updateValue((_state_key(name),), astuple(latch))

    def arrive(self, device: str, part: pd.DataFrame, latch: Latch) -> pd.DataFrame:
        """Take one device's readings of a micro-batch, in order of arrival."""
        return self._arrive([device], np.zeros(len(part), np.int64), part, [latch])

    def _arrive(self, names: list[str | None], of: np.ndarray, part: pd.DataFrame, latches: list[Latch]) -> pd.DataFrame:
        """Take readings of several devices, ``of`` being their places in ``names``: by device, then in order of arrival."""
        cfg = self.cfg
        news = np.full((len(part), 4), np.nan)
        news[:, TIME], news[:, AIR], news[:, HEATER] = part["observed_at_ms"], part["air"], part["heater"]
        number = (news[:, TIME] // cfg.window_ms).astype(np.int64)
        first = np.searchsorted(of, np.arange(len(names) + 1))
        late = np.zeros(len(part), bool)
        held = []
        for i, latch in enumerate(latches):
            if latch.lowest is not None:
                late[first[i]:first[i + 1]] = number[first[i]:first[i + 1]] - 1 < latch.lowest
            held.append(self._held(names[i], latch))
        stored_of = np.repeat(np.arange(len(names)), [len(rows) for rows in held])
        line = Timeline(np.concatenate([np.zeros((0, 4)), *held]), news, stored_of, of)
        rates = line.rates(cfg)
        rates[late] = np.nan
        news[:, RATE] = line.rows[line.place, RATE] = rates[:, 1]
        sessions = [latches[i].advance(cfg, now, heater, news[at], lambda t, at=at: line.since(t, at)) for at, (i, now, heater) in enumerate(
            zip(of.tolist(), news[:, TIME].astype(np.int64).tolist(), news[:, HEATER].tolist(), strict=True))]
        for i, latch in enumerate(latches):
            self._hold(names[i], latch, held[i], news[first[i]:first[i + 1]], number[first[i]:first[i + 1]])
        columns = {name: part[name].to_numpy() for name in ("message_key", "arrival", "payload")}
        columns |= {"device_id": np.array(names, object)[of], "observed_at_ms": news[:, TIME].astype(np.int64), "late": late}
        columns |= {name: [None if np.isnan(r) else r for r in rates[:, i].tolist()] for i, name in enumerate(
            ("sauna_rate_c_per_min", "stovepipe_rate_c_per_min"))}
        none = (None,) * 7
        columns |= dict(zip(NAMES[8:], zip(*(s or none for s in sessions), strict=True), strict=True))
        return pd.DataFrame(columns, columns=NAMES, dtype=object)

    def _numbers(self, device: str | None, latch: Latch) -> list[int]:
        """The stored blocks of a device whose readings are kept in blocks."""
        name = _state_key(device)
        return [n for n in range(latch.lowest, latch.lowest + self.blocks_back + 1) if self.blocks.containsKey((name, n))]

    def _held(self, device: str | None, latch: Latch) -> np.ndarray:
        """The stored readings of a device, within a block in order of arrival."""
        rows = latch.near if latch.near is not None else b"".join(
            self.blocks.getValue((_state_key(device), n))[0] for n in self._numbers(device, latch))
        return np.frombuffer(rows).reshape(-1, 4)

    def _hold(self, device: str | None, latch: Latch, held: np.ndarray, news: np.ndarray, number: np.ndarray) -> None:
        """Store a device's readings in reach of its newest one; of those kept in blocks only the changed blocks."""
        name = _state_key(device)
        stored = [] if latch.near is not None else self._numbers(device, latch)
        newest = max(int(number.max()), -(1 << 62) if latch.lowest is None else latch.lowest + self.blocks_back)
        latch.lowest = newest - self.blocks_back
        of = (held[:, TIME] // self.cfg.window_ms).astype(np.int64)
        there, fresh = of >= latch.lowest, number >= latch.lowest
        small = 32 * (np.count_nonzero(there) + np.count_nonzero(fresh)) <= NEAR
        changed = [] if small else np.unique(np.concatenate([of[there], number[fresh]]) if latch.near is not None else number[fresh]).tolist()
        latch.near = held[there].tobytes() + news[fresh].tobytes() if small else None
        for n in changed:
            self.blocks.updateValue((name, n), (held[of == n].tobytes() + news[number == n].tobytes(),))
        for n in stored:
            if small or n < latch.lowest:
                self.blocks.removeKey((name, n))


def _state_key(device: str | None) -> str:
    return "" if device is None else f"={device}"


def device_stream(readings: DataFrame, cfg: RuntimeConfig, arrival: str = "arrival", lanes: int = BUCKETS) -> DataFrame:
    """Rates and session state of each arriving reading.

    ``arrival`` sorts the readings of a micro-batch (whole numbers are made texts that sort alike). A
    ``payload`` text is passed on; rows without ``message_key`` are passed on as they are. A
    micro-batch's readings of one device, and of the other devices of its lane, are put in arrival order by one
    task, so the batch size (files or offsets per trigger) bounds what a device that sends very much puts into
    a task. The number of ``lanes`` must stay the same as long as a checkpoint is used.
    """
    order = F.col(arrival)
    if dict(readings.dtypes)[arrival] != "string":
        order = F.lpad((order.cast("decimal(20,0)") + F.lit(Decimal(2 ** 63))).cast("string"), 20, "0")
    payload = F.col("payload") if "payload" in readings.columns else F.lit(None).cast("string")
    narrow = readings.select(
        "device_id", "message_key", F.col("observed_at_ms").cast("double"), F.col("sauna_temp_c").alias("air"),
        F.col("stovepipe_temp_c").alias("heater"), order.alias("arrival"), payload.alias("payload"))
    lane = F.pmod(F.xxhash64("device_id"), F.lit(lanes))
    return narrow.withColumn("_lane", lane).groupBy("_lane").transformWithStateInPandas(
        DeviceProcessor(cfg), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


# Late readings are rated in stretches of so many windows, and these dealt into so many groups: a stretch is bounded by time.
STRETCH = 8
GROUPS = 1_024
SEEN = "_group bigint, device_id string, _stretch bigint, t bigint, batch bigint, arrival string, sauna_temp_c double, stovepipe_temp_c double"
RATES = "message_key string, sauna_rate_c_per_min double, stovepipe_rate_c_per_min double"
# A larger value would blur the running sums of its neighbours; windows that hold one are summed by themselves.
WILD = 1e6


class Arrivals:
    """Readings by time, asked for what had arrived by then: question ``j`` sees those with ``since <= j``.

    The readings are kept once per power of two, grouped by ``since`` in ranges of that length; what
    a question sees is at most one range of each length, so its cost does not grow with the readings.
    A question sees readings of its own group only.
    """

    def __init__(self, group: np.ndarray, time: np.ndarray, since: np.ndarray, asker: np.ndarray):
        self.levels = []
        self.places, self.asker = Places(group, time), asker
        order = self.places.order()
        for level in range(len(asker).bit_length()):
            self.levels.append((level, order[np.argsort(since[order] >> level, kind="stable")]))
        # Times as places in the sorted times, so that range and time are one number to search for.
        self.sorted = time[order]
        self.nth = np.empty(len(time), np.int64)
        self.nth[order] = np.arange(len(time))
        self.since = since

    def spans(self, low: np.ndarray, high: np.ndarray):
        """Per level: the questions that see a range of it, the rows in time order, and the part in [low, high]."""
        seen = np.arange(len(low)) + 1
        first, after = self.places.begin(self.asker, low), self.places.end(self.asker, high)
        width = len(self.sorted) + 1
        for level, place in self.levels:
            which = np.flatnonzero((seen >> level) & 1)
            part = ((seen[which] >> level) - 1) * width
            line = (self.since[place] >> level) * width + self.nth[place]
            yield which, place, np.searchsorted(line, part + first[which]), np.searchsorted(line, part + after[which])

    def total(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of the columns of ``values`` over the readings seen in [low, high]."""
        out = np.zeros((len(low), values.shape[1]), values.dtype)
        for which, place, begin, end in self.spans(low, high):
            sums = np.concatenate([np.zeros((1, values.shape[1]), values.dtype), np.cumsum(values[place], axis=0)])
            out[which] += sums[end] - sums[begin]
        return out

    def ends(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The earliest and the latest time seen in [low, high], infinite where there is none."""
        first, last = np.full(len(low), np.inf), np.full(len(low), -np.inf)
        for which, place, begin, end in self.spans(low, high):
            some = begin < end
            which, begin, end = which[some], begin[some], end[some]
            nth = self.nth[place]
            first[which] = np.minimum(first[which], self.sorted[nth[begin]])
            last[which] = np.maximum(last[which], self.sorted[nth[end - 1]])
        return first, last


def seen_rates(cfg: RuntimeConfig, time: np.ndarray, values: np.ndarray, since: np.ndarray, now: np.ndarray,
               group: np.ndarray | None = None, asker: np.ndarray | None = None) -> np.ndarray:
    """Rates at the times ``now`` of questions in order of arrival, of the readings (by row) that each sees.

    ``group`` and ``asker`` are the groups (whole numbers from 0) of the readings and of the questions, one without them.
    """
    group = np.zeros(len(time), np.int64) if group is None else group
    asker = np.zeros(len(now), np.int64) if asker is None else asker
    out = np.full((len(now), values.shape[1]), np.nan)
    every = Arrivals(group, time, since, asker)
    floor, begin = now - cfg.window_ms, now.astype(float)
    moved = np.ones(len(now), bool)
    while moved.any():  # two steps pass more than a gap
        earliest = every.ends(np.maximum(floor, begin - cfg.max_gap_ms), begin)[0]
        moved = earliest < begin
        begin = np.where(moved, earliest, begin)
    for side in range(values.shape[1]):
        known = np.flatnonzero(np.isfinite(values[:, side]))
        if not len(known):
            continue
        own, value, t = group[known], values[known, side], time[known]
        of = Arrivals(own, t, since[known], asker)
        wild = np.abs(value) > WILD
        # Times and values of a group are counted from one of its own, so that the sums stay small.
        origin, centre = np.full(group.max() + 1, t.max()), np.zeros(group.max() + 1)
        np.minimum.at(origin, own, t)
        centre[own[~wild]] = value[~wild]
        x, y = (((t - origin[own]) / MINUTE_MS).astype(np.longdouble), (value - centre[own]).astype(np.longdouble))
        y[wild] = 0
        n, odd, sx, sy, sxx, sxy = of.total(np.stack([np.ones(len(t)), wild, x, y, x * x, x * y], axis=1), begin, now).T
        first, last = of.ends(begin, now)
        enough = (n >= 3) & (last - first >= cfg.span_ms)
        n = np.maximum(n, 1)
        spread = sxx - sx * sx / n
        enough &= (last > first) & (spread > 0)
        out[:, side] = np.where(enough, (sxy - sx * sy / n) / np.where(enough, spread, 1), np.nan)
        for j in np.flatnonzero(enough & (odd > 0)):
            there = (own == asker[j]) & (since[known] <= j) & (t >= begin[j]) & (t <= now[j])
            minutes, held = (t[there] - now[j]) / MINUTE_MS, value[there]
            minutes = minutes - minutes.mean()
            out[j, side] = (minutes * (held - held.mean())).sum() / (minutes * minutes).sum()
    return out


def late_rates(late: DataFrame, stored: DataFrame, cfg: RuntimeConfig) -> DataFrame:
    """``late`` readings with their rates, from the stored readings that arrived before them or with them.

    Both have device_id, observed_at_ms, batch and arrival (stored ones also the two temperatures).
    Late readings meet the stored ones of their device and stretch of time, many stretches side by side, which are sorted and
    summed, so that the work does not grow with the number of readings in a window. Of batches
    before the first late reading all is seen: their arrival is not looked at.
    """
    channels = {"sauna_temp_c": "sauna_rate_c_per_min", "stovepipe_temp_c": "stovepipe_rate_c_per_min"}
    width = cfg.window_ms
    time, batch = F.col("observed_at_ms"), F.col("batch").cast("bigint").alias("batch")
    # A reading is also in reach of the stretch after its own, if it is in the last window of it.
    block = number_of(time, width)
    stretches = F.array_distinct(F.array(F.floor(block / STRETCH), F.floor((block + 1) / STRETCH)))
    # Both may come from one table, so the columns get names of their own.
    asked = late.select("message_key", F.col("device_id").alias("_device"), F.floor(block / STRETCH).alias("_home"), time.alias("now"),
                        batch, F.col("arrival").alias("arrival"))
    wanted = asked.groupBy(F.col("_device").alias("device_id"), F.col("_home").alias("_stretch")).agg(F.min("batch").alias("_since"))
    known = stored.select("device_id", F.explode(stretches).alias("_stretch"), time.alias("t"), batch, "arrival", *channels).join(
        wanted, ["device_id", "_stretch"]).withColumn("arrival", F.when(F.col("batch") >= F.col("_since"), F.col("arrival")))
    known = known.withColumn("_group", F.pmod(F.xxhash64("device_id", "_stretch"), F.lit(GROUPS))).select(
        *[part.split()[0] for part in SEEN.split(", ")])
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("_device", "_home"), F.lit(GROUPS)))

    def rate(asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        came = pd.concat([asked[["_device", "_home", "batch", "arrival"]], seen[["device_id", "_stretch", "batch", "arrival"]].set_axis(
            ["_device", "_home", "batch", "arrival"], axis=1)], ignore_index=True).fillna({"arrival": ""})
        line = came.groupby(["_device", "_home"], dropna=False).ngroup().rename("line")
        # Stretch by stretch, and within a stretch in order of arrival.
        number = came.groupby([line, "batch", "arrival"], sort=True).ngroup().to_numpy()
        order = np.argsort(number[:len(asked)], kind="stable")
        asked, line = asked.iloc[order], line.to_numpy()
        questions, rows = number[:len(asked)][order], number[len(asked):]
        found = seen_rates(cfg, seen["t"].to_numpy(np.int64), seen[list(channels)].to_numpy(float),
                           np.searchsorted(questions, rows, "left"), asked["now"].to_numpy(np.int64),
                           line[len(asked):], line[:len(asked)][order])
        columns = [[None if np.isnan(r) else r for r in found[:, i].tolist()] for i in range(2)]
        return pd.DataFrame({"message_key": asked["message_key"].to_numpy(), **dict(zip(channels.values(), columns, strict=True))}, dtype=object)

    rates = asked.groupBy("_group").cogroup(known.groupBy("_group")).applyInPandas(rate, RATES)
    return late.drop(*channels.values()).join(rates, "message_key", "left").select(*late.columns)


def sessions_of(device_rows: DataFrame) -> DataFrame:
    """The sessions table from stored stream output: the furthest state of each session."""
    fields = NAMES[9:]
    return (
        device_rows.where("started_at_ms IS NOT NULL").groupBy("device_id", "started_at_ms")
        .agg(F.max_by(F.struct(*fields), "sample_count").alias("_s"))
        .select("device_id", "started_at_ms", "_s.*")
        .withColumn("complete", F.col("ended_at_ms").isNotNull().cast("int"))
    )
