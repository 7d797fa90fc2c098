import contextlib
import io
import json
import os
import random
import time

import numpy as np
import pandas as pd
import sequential
from messages import uplink, with_payload

from emberline import RuntimeConfig
from emberline.plans import telemetry
from emberline.session import shared_folder
from emberline.sources.messages import json_message_stream
from emberline.streaming import ingest as streams
from emberline.streaming.devices import OUTPUT, DeviceProcessor, Latch, device_stream, late_rates, seen_rates, sessions_of
from emberline.streaming.keys import PAGE, FirstOfKey, Pages, in_arrival_order

MINUTE = 60_000
FIELDS = "device_id string, message_key string, observed_at_ms long, sauna_temp_c double, stovepipe_temp_c double, n long"


def plan_of(query):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        query.explain()
    return out.getvalue()


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_ingest_stores_each_message_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stored, offsets = str(tmp_path / "stored"), str(tmp_path / "offsets")
    stream = json_message_stream(spark, str(source))

    def deliver(name, *bodies):
        (source / name).write_text("\n".join(b if isinstance(b, str) else json.dumps(b) for b in bodies) + "\n")
        run(streams.ingest(stream, RuntimeConfig(), stored, offsets, buckets=3))

    one, two = uplink(key="gs:uplink:1"), uplink(key="gs:uplink:2")
    deliver("a.json", one, uplink(key="gs:uplink:1", first=50), "{", with_payload(uplink(), BatV=1))
    deliver("b.json", two, uplink(key="gs:uplink:1", first=99))
    got = streams.stored_rows(spark, stored).orderBy("message_key").collect()
    assert [(r.message_key, r.temp_channel_1_c, r.batch) for r in got] == [("gs:uplink:1", 18.75, 0), ("gs:uplink:2", 18.75, 1)]
    assert sorted(r.reason for r in streams.quarantined_rows(spark, stored).collect()) == [
        "Message is not valid JSON", "Uplink contained no temperature readings"]


def test_no_stream_plan_reads_what_is_stored(spark, tmp_path):
    """Repeats are found in the state: the batches that ingest writes have no join."""
    source, stored = tmp_path / "in", str(tmp_path / "stored")
    source.mkdir()
    plans = []
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps(uplink(key="gs:uplink:1")) + "\n")
        writer = streams.ingest(json_message_stream(spark, str(source)), RuntimeConfig(), stored, str(tmp_path / "offsets"), buckets=3)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        plans.append(plan_of(query))
    assert all("TransformWithStateInPySpark" in plan and "Join" not in plan and "stored" not in plan for plan in plans)
    assert streams.stored_rows(spark, stored).count() == 1


def test_a_retried_batch_writes_the_same(spark, tmp_path):
    """The commit of the last batch is lost: run again, it replaces what it wrote."""
    source, stored, late = tmp_path / "in", str(tmp_path / "stored"), str(tmp_path / "late")
    source.mkdir()

    def once():
        run(streams.pipeline(json_message_stream(spark, str(source), 1), RuntimeConfig(), stored, late, str(tmp_path / "offsets"), buckets=3))
        return sorted(map(tuple, streams.derived_rows(spark, stored, late).drop("arrival").collect()), key=str)

    for n in range(3):
        (source / f"{n}.json").write_text("".join(json.dumps(uplink(key=f"gs:uplink:{k}")) + "\n" for k in (n, n, 7)))
        rows = once()
    for name in ("2", ".2.crc"):
        (tmp_path / "offsets" / "commits" / name).unlink(missing_ok=True)
    assert once() == rows
    assert len(rows) == 4


def test_arrival_follows_time_file_and_line(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, name in enumerate(("b.json", "a.json")):
        (source / name).write_text("".join(f"{name}-{i}\n" for i in range(30)))
        os.utime(source / name, (1_000 + n, 1_000 + n))
    out = str(tmp_path / "out")
    run(in_arrival_order(spark.readStream.text(str(source))).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "offsets")))
    rows = spark.read.parquet(out).collect()
    assert [r.value for r in sorted(rows, key=lambda r: r.arrival)] == [f"{f}.json-{i}" for f in "ba" for i in range(30)]


class Held(dict):
    """The map state of one device."""

    def getValue(self, key):  # noqa: N802
        return self[key]

    def containsKey(self, key):  # noqa: N802
        return key in self

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]


def dense_device(n):
    rng = np.random.default_rng(2)
    times = np.sort(rng.integers(0, n * 20_000, n))
    return pd.DataFrame({"observed_at_ms": times.astype(float), "air": 20.0, "heater": rng.uniform(20, 90, n),
                         "message_key": [str(i) for i in range(n)], "arrival": [f"{i:09d}" for i in range(n)], "payload": None})


def run_in(cfg, parts):
    device, latch, sizes = DeviceProcessor(cfg), Latch(), []
    device.blocks = Held()
    out = []
    for part in parts:
        out.append(device.arrive("d", part, latch))
        sizes.append((len(device.blocks), sum(len(rows) for rows, in device.blocks.values())))
    return pd.concat(out, ignore_index=True), sizes


def test_one_dense_device_is_fast_and_borders_do_not_matter():
    cfg = RuntimeConfig()
    frame = dense_device(8_000)
    late = frame[:1].assign(observed_at_ms=frame.observed_at_ms[7_990] + 1, heater=30.0, message_key="late", arrival="9")
    frame = pd.concat([frame, late], ignore_index=True)
    begun = time.perf_counter()
    whole, _ = run_in(cfg, [frame])
    assert time.perf_counter() - begun < 1
    cut, _ = run_in(cfg, [frame[:700], frame[700:5_000], frame[5_000:]])
    rate = "stovepipe_rate_c_per_min"
    assert np.allclose(whole[rate].astype(float), cut[rate].astype(float), rtol=0, atol=1e-9, equal_nan=True)
    assert whole.iloc[-1].sauna_rate_c_per_min == 0 and pd.isna(whole.iloc[-1].started_at_ms)
    others = ["sauna_rate_c_per_min", rate, "max_stovepipe_rate_c_per_min"]
    assert whole.drop(columns=others).equals(cut.drop(columns=others))


def test_device_state_stays_bounded():
    """However long a device reports, its state holds the blocks in reach and no more."""
    cfg = RuntimeConfig()
    frame = dense_device(6_000)
    _, sizes = run_in(cfg, [frame[at:at + 300] for at in range(0, 6_000, 300)])
    blocks = DeviceProcessor(cfg).blocks_back + 1
    assert max(n for n, _ in sizes) <= blocks
    # 20 s apart on average, so about 45 readings of 32 bytes in a block of 15 minutes.
    assert max(size for _, size in sizes) < 2 * 45 * 32 * blocks
    early = frame[:1].assign(observed_at_ms=1.0, message_key="late", arrival="9")
    rows, sizes = run_in(cfg, [frame, early])
    assert rows.iloc[-1].late and rows.iloc[-1].stovepipe_rate_c_per_min is None
    assert not rows[:-1].late.any() and sizes[-1] == sizes[0]


def test_devices_match_a_sequential_loop_over_several_batches(spark, tmp_path):
    rng = random.Random(11)
    cfg = RuntimeConfig()
    series = {}
    for device in range(6):
        now, level, rows = 0, 60.0, []
        for _ in range(120):
            now += rng.choice([5, 5, 5, 5, 12, 13, 60]) * MINUTE
            level = min(max(level + rng.uniform(-35, 35), 10.0), 140.0)
            rows.append((now, rng.choice([None, level / 2]), level))
        series[f"d{device}"] = rows
    source = tmp_path / "in"
    late = ("d0", "late", 30 * MINUTE, 500.0, 500.0, 10_000)
    for part in range(3):
        rows = [(d, f"{d}-{n}", *row, n) for d, readings in series.items()
                for n, row in enumerate(readings) if part * 40 <= n < (part + 1) * 40]
        rows += [late] if part == 2 else []
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(str(source))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(source))
    run(device_stream(stream, cfg, "n").writeStream.option("checkpointLocation", shared_folder(spark, "offsets"))
        .format("parquet").option("path", out))
    rows = spark.read.schema(OUTPUT).parquet(out)
    got = {r.message_key: r for r in rows.collect()}
    assert len(got) == 6 * 120 + 1
    assert got["late"].started_at_ms is None
    expected = {}
    for device, readings in series.items():
        rates = sequential.rates(readings, cfg)
        for n, pair in enumerate(rates):
            row = got[f"{device}-{n}"]
            for have, want in zip((row.sauna_rate_c_per_min, row.stovepipe_rate_c_per_min), pair, strict=True):
                assert (have is None) == (want is None)
                assert want is None or abs(have - want) < 1e-9
        for s in sequential.sessions(readings, cfg, [h for _, h in rates]):
            expected[device, s["start"]] = (s["end"], s["hot"], s["rows"], s["air"], s["heater"])
    found = {(r.device_id, r.started_at_ms): (r.ended_at_ms, r.last_hot_at_ms, r.sample_count, r.peak_sauna_c, r.peak_stovepipe_c)
             for r in sessions_of(rows).collect()}
    assert found == expected


def test_late_rates_match_a_sequential_loop(spark):
    """Readings too late for the state: what had arrived by then counts, cut at the last gap."""
    rng = random.Random(4)
    cfg = RuntimeConfig()
    rows, late, expected = [], [], {}
    for device in range(3):
        came = []
        for n in range(200):
            held = rng.random() < 0.2
            t = rng.randrange(0, 200) * 97_000 - 3_000_000
            came.append((t, rng.choice([None, rng.uniform(0, 50)]), rng.uniform(20, 90)))
            row = (f"d{device}", f"{device}-{n}", t, n // 50, f"{n:04d}", came[-1][1], came[-1][2])
            rows.append(row)
            if held:
                late.append(row)
                # Of readings of one time those that came first stand first.
                there = sorted((r for r in came if r[0] <= t), key=lambda r: r[0])
                expected[row[1]] = sequential.rates(there, cfg)[-1]
    schema = "device_id string, message_key string, observed_at_ms long, batch int, arrival string, sauna_temp_c double, stovepipe_temp_c double"
    stored = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame(late, schema).selectExpr(
        "*", "cast(null as double) sauna_rate_c_per_min", "cast(null as double) stovepipe_rate_c_per_min")
    got = late_rates(asked, stored, cfg).collect()
    assert len(got) == len(late)
    assert any(r.stovepipe_rate_c_per_min is not None for r in got)
    for r in got:
        for have, want in zip((r.sauna_rate_c_per_min, r.stovepipe_rate_c_per_min), expected[r.message_key], strict=True):
            assert (have is None) == (want is None)
            assert want is None or abs(have - want) < 1e-6


def test_late_rates_do_not_pair_readings_with_their_windows():
    """30,000 late readings that see 30,000 stored and each other, all in one window: no pairs of them are formed."""
    rng = np.random.default_rng(5)
    cfg = RuntimeConfig()
    at = rng.integers(0, cfg.window_ms, 60_000)
    since = np.r_[np.zeros(30_000, int), np.arange(30_000)]
    values = rng.uniform(20, 90, (60_000, 2))
    values[0, 1] = 1e12  # blurs nobody's rate but those of windows that hold it
    at[0] = cfg.window_ms - 1
    begun = time.perf_counter()
    rates = seen_rates(cfg, at, values, since, at[30_000:])
    assert time.perf_counter() - begun < 10
    for j in rng.integers(0, 30_000, 50):
        now = at[30_000 + j]
        there = (since <= j) & (at <= now)
        wide = now - at[there].min() >= cfg.span_ms
        for side in range(2):
            want = np.polyfit((at[there] - now) / MINUTE, values[there, side], 1)[0] if wide else np.nan
            assert np.isclose(rates[j, side], want, rtol=1e-6, atol=1e-9, equal_nan=True)


def test_a_stored_reading_without_arrival_counts_if_its_batch_is_earlier(spark):
    cfg = RuntimeConfig()
    columns = "device_id string, message_key string, observed_at_ms long, batch int, arrival string, sauna_temp_c double, stovepipe_temp_c double"
    rows = [("d", str(n), n * 3 * MINUTE, n // 4, None if n < 4 else f"{n}", None, 20.0 + 3 * n) for n in range(5)]
    stored = spark.createDataFrame(rows, columns)
    late = stored.where("batch = 1").selectExpr("*", "0D sauna_rate_c_per_min", "0D stovepipe_rate_c_per_min")
    row = late_rates(late, stored, cfg).first()
    assert row.sauna_rate_c_per_min is None and abs(row.stovepipe_rate_c_per_min - 1) < 1e-9


def test_the_new_rows_of_a_bucket_are_tidied_and_passed_on_in_parts():
    """Copies in any order and part give the first of each key, stored ones nothing, in parts of bounded size."""
    step = FirstOfKey("message_key")
    step.seen = Held({("k7",): (True,)})
    order = np.random.default_rng(1).permutation(60_000)
    frame = pd.DataFrame({"message_key": [f"k{n % 25_000}" for n in order], "arrival": [f"{n:06d}" for n in order]})
    parts = list(step.handleInputRows((0,), iter(frame[at:at + 5_000] for at in range(0, 60_000, 5_000)), None))
    assert max(map(len, parts)) <= 10_000
    got = pd.concat(parts)
    assert list(got["arrival"]) == [f"{n:06d}" for n in range(25_000) if n != 7]
    assert len(step.seen) == 25_000


def test_large_parts_arrive_as_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(telemetry, "FILE_ROWS", 100)
    rows = spark.range(1_000).selectExpr("id % 2 AS user_id", "id AS ts", "0 AS part", "cast(id AS string) AS value")
    telemetry._send(rows, str(tmp_path / "sent"), "text")
    files = list((tmp_path / "sent").glob("part-*"))
    assert max(len(f.read_text().splitlines()) for f in files) <= 100
    assert sorted(int(n) for f in files for n in f.read_text().split()) == list(range(1_000))


class Counted(Held):
    """A map state that counts its calls."""

    calls = 0

    def __getattribute__(self, name):
        if name.endswith("Key") or name.endswith("Value"):
            self.calls += 1
        return super().__getattribute__(name)


def test_keys_lie_in_pages_of_bounded_size_and_cost_few_state_calls():
    """Batches that repeat half of what is stored: exact answers, several keys a call, each written a few times."""
    rng = random.Random(3)
    pages, seen, asked = Pages(Counted()), set(), 0
    for _ in range(12):
        names = {f"ä:{rng.randrange(60_000)}\n\"" for _ in range(10_000)}
        asked += len(names)
        assert pages.which(names) == names & seen
        pages.add(names - seen)
        seen |= names
    assert pages.which({"other"}) == set()
    assert pages.state.calls < asked / 20
    held = {place: json.loads(text) for place, (text,) in pages.state.items() if place != Pages.DIRECTORY}
    assert sorted(name for keys in held.values() for name in keys) == sorted(seen)
    sizes = {}
    for (page, _), keys in held.items():
        sizes[page] = sizes.get(page, 0) + len(keys)
    assert max(sizes.values()) < 3 * PAGE and len(sizes) > 1
    # A later small batch touches the pages of its own keys only.
    pages.state.calls = 0
    pages.add({"one more"})
    assert pages.state.calls < 20


def test_first_of_key_asks_and_fills_the_pages():
    step = FirstOfKey("message_key")
    step.seen = Pages(Counted())

    def batch(low, high):
        frame = pd.DataFrame({"message_key": [None if n % 1_000 == 0 else f"k{n}" for n in range(low, high)], "arrival": [f"{n:06d}" for n in range(low, high)]})
        parts = [frame[at:at + 700] for at in range(0, len(frame), 700)]
        return pd.concat(list(step.handleInputRows((0,), iter(parts), None)))["arrival"].tolist()

    assert len(batch(0, 5_000)) == 5_000
    assert sorted(batch(3_000, 8_000)) == [f"{n:06d}" for n in range(3_000, 8_000) if n >= 5_000 or n % 1_000 == 0]
    assert step.seen.state.calls < 500


def lane_of(cfg, frames, batches=1):
    """The rows of devices taken in together, in some micro-batches, and the state calls of the last."""
    device = DeviceProcessor(cfg)
    device.blocks, device.latches = Counted(), Counted()
    device.latches.getValue = device.latches.get  # None for a device not yet met
    out = []
    for part in range(batches):
        rows = pd.concat([f.assign(device_id=name)[part * len(f) // batches:(part + 1) * len(f) // batches] for name, f in frames.items()])
        device.blocks.calls = device.latches.calls = 0
        out += list(device.handleInputRows((0,), iter([rows.sample(frac=1, random_state=part)]), None))
    every = pd.concat(out).sort_values(["device_id", "arrival"], ignore_index=True)
    return every, device.blocks.calls + device.latches.calls, len(device.blocks)


def test_devices_of_a_lane_are_taken_in_side_by_side(monkeypatch):
    """Many devices in one call: each as if alone, two state calls a device; kept in blocks or not makes no difference."""
    cfg = RuntimeConfig()
    frames = {f"d{n}": dense_device(400 + 7 * n).assign(heater=lambda f, n=n: (f.heater * (1 + n) * 7) % 90 + 20) for n in range(12)}
    whole, _, _ = lane_of(cfg, frames)
    for name, frame in frames.items():
        alone, _ = run_in(cfg, [frame])
        assert whole[whole.device_id == name].reset_index(drop=True).assign(device_id="d").equals(alone)
    parts, calls, blocks = lane_of(cfg, frames, batches=4)
    assert calls == 2 * len(frames) and blocks == 0
    monkeypatch.setattr("emberline.streaming.devices.NEAR", 100)
    spread, _, blocks = lane_of(cfg, frames, batches=4)
    assert blocks > 0
    exact = [c for c in whole.columns if "rate" not in c]
    for other in (parts, spread):
        assert whole[exact].equals(other[exact])
        for rate in ("sauna_rate_c_per_min", "stovepipe_rate_c_per_min"):
            assert np.allclose(whole[rate].astype(float), other[rate].astype(float), rtol=0, atol=1e-9, equal_nan=True)


def test_late_rates_of_many_stretches_are_made_in_one_call():
    """Questions and readings of 300 groups at once: the rates of each group by itself, without a step per group."""
    rng = np.random.default_rng(8)
    cfg = RuntimeConfig()
    times, values, since, now, group, asker, alone = [], [], [], [], [], [], []
    for g in range(300):
        t, asked = rng.integers(0, 60 * MINUTE, 40) + g * MINUTE, np.sort(rng.integers(20, 60, 15)) * MINUTE + g * MINUTE
        v, s = rng.uniform(-9, 90, (40, 2)), rng.integers(0, 16, 40)
        v[rng.random((40, 2)) < 0.2] = np.nan
        alone.append(seen_rates(cfg, t, v, s, asked))
        times.append(t), values.append(v), since.append(s + 15 * g), now.append(asked)
        group.append(np.full(40, g)), asker.append(np.full(15, g))
    order = rng.permutation(300 * 40)
    together = seen_rates(cfg, np.concatenate(times)[order], np.concatenate(values)[order], np.concatenate(since)[order],
                          np.concatenate(now), np.concatenate(group)[order], np.concatenate(asker))
    assert np.isfinite(together).sum() > 1_000
    assert np.allclose(together, np.concatenate(alone), rtol=0, atol=1e-10, equal_nan=True)
