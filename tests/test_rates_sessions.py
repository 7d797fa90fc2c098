import random

import pytest
import sequential
from pyspark.sql import functions as F

from emberline import RuntimeConfig
from emberline.operators import slices
from emberline.operators.rates import gap_segments, with_rates
from emberline.operators.sessions import (
    active_devices, any_open_session, detect_sessions, open_sessions, sessions_since,
)
from emberline.schema import devices_with_two_open_sessions

MINUTE = 60_000
SCHEMA = ("device_id string, observed_at_ms long, inserted_at_ms long, message_key string, "
          "sauna_temp_c double, stovepipe_temp_c double")


def frame(spark, series):
    """series: {device: [(ms, air, heater), ...]} in arrival order."""
    def real(value):
        return None if value is None else float(value)

    rows = [(device, t, n, f"{device}-{n}", real(a), real(h))
            for device, readings in series.items() for n, (t, a, h) in enumerate(readings)]
    return spark.createDataFrame(rows, SCHEMA)


def golden_rates(spark, points, **settings):
    cfg = RuntimeConfig(**{"expected_interval_s": 288, **settings})
    got = with_rates(frame(spark, {"d": [(m * MINUTE, a, h) for m, a, h in points]}), cfg)
    last = got.orderBy(F.desc("observed_at_ms")).first()
    return last.sauna_rate_c_per_min, last.stovepipe_rate_c_per_min


@pytest.mark.parametrize(("points", "span", "expected"), [
    ([(0, 20), (5, 25), (10, 30)], 8, 1.0),
    ([(0, 20), (2, 21), (7, 23.5)], 7, 0.5),
    ([(0, 20), (10, 30)], 8, None),
    ([(0, 20), (2, 21), (4, 22)], 8, None),
    ([(0, 20), (5, 25), (30, 100)], 8, None),
])
def test_rate_of_known_series(spark, points, span, expected):
    air, heater = golden_rates(spark, [(m, v, v) for m, v in points], rate_span_min=span)
    assert air == (expected if expected is None else pytest.approx(expected, abs=1e-10))
    assert heater == air


def test_channels_are_independent(spark):
    air, heater = golden_rates(spark, [(0, None, 20.0), (5, None, 30.0), (10, None, 40.0)])
    assert air is None
    assert heater == pytest.approx(2, abs=1e-10)


def random_series(rng, ties):
    now = rng.choice([-3_000_000, 0, 1_700_000_000_000])
    rows = []
    level = rng.uniform(20, 120)
    for _ in range(rng.randint(1, 160)):
        step = rng.choice([1, 2, 5, 5, 5, 5, 12, 13, 15, 40, 60, 400, 2_000])
        if not (ties and rows and rng.random() < 0.2):
            now += step * MINUTE + rng.choice([0, 0, 1, -1])
        level += rng.uniform(-40, 40)
        level = min(max(level, 10), 150)
        heater = None if rng.random() < 0.1 else round(level, 1)
        air = None if rng.random() < 0.3 else round(level / 2, 2)
        rows.append((now, air, heater))
    return rows


@pytest.mark.parametrize(("seed", "ties", "samples", "hold"), [
    (1, False, 2, 45), (2, True, 2, 45), (3, True, 3, 20), (4, False, 1, 120), (5, True, 2, 5),
])
def test_rates_and_sessions_match_a_sequential_loop(spark, monkeypatch, seed, ties, samples, hold):
    monkeypatch.setattr(slices, "SPANS_PER_SLICE", seed)  # short slices: many borders are crossed
    rng = random.Random(seed)
    cfg = RuntimeConfig(start_samples=samples, end_hold_min=hold)
    series = {f"d{n}": random_series(rng, ties) for n in range(60)}
    readings = frame(spark, series)

    expected_rates = {d: sequential.rates(rows, cfg) for d, rows in series.items()}
    for row in with_rates(readings, cfg).collect():
        air, heater = expected_rates[row.device_id][row.inserted_at_ms]
        for got, want in ((row.sauna_rate_c_per_min, air), (row.stovepipe_rate_c_per_min, heater)):
            assert got == (None if want is None else pytest.approx(want, abs=1e-9))

    want = {}
    for device, rows in series.items():
        for s in sequential.sessions(rows, cfg, [h for _, h in expected_rates[device]]):
            want[device, s["start"]] = s
    got = detect_sessions(readings, cfg)
    assert devices_with_two_open_sessions(got).isEmpty()
    found = {(r.device_id, r.started_at_ms): r for r in got.collect()}
    assert found.keys() == want.keys()
    assert len(found) > 40
    for key, row in found.items():
        s = want[key]
        assert (row.ended_at_ms, row.last_hot_at_ms, row.sample_count) == (s["end"], s["hot"], s["rows"])
        assert (row.peak_sauna_c, row.peak_stovepipe_c) == (s["air"], s["heater"])
        assert row.complete == (s["end"] is not None)
        rate = row.max_stovepipe_rate_c_per_min
        assert rate == (None if s["rate"] is None else pytest.approx(s["rate"], abs=1e-9))


def test_an_absurd_value_stays_within_its_frames(spark):
    rows = [(n * 5 * MINUTE, 20.0 + n, 1e300 if n == 3 else 20.0 + n) for n in range(30)]
    got = with_rates(frame(spark, {"d": rows}), RuntimeConfig()).where("inserted_at_ms > 6").collect()
    assert all(r.stovepipe_rate_c_per_min == pytest.approx(0.2, abs=1e-12) for r in got)


@pytest.mark.parametrize(("points", "expected"), [
    ([(0, 80), (5, 95)], [(0, None)]),
    ([(0, 80), (20, 95)], []),
    ([(0, 80), (5, 90), (10, 80), (30, 45)], [(0, None)]),
    ([(0, 80), (5, 90), (10, 80), (30, 45), (60, 40)], [(0, 10)]),
])
def test_sessions_of_known_series(spark, points, expected):
    got = detect_sessions(
        frame(spark, {"d": [(m * MINUTE, None, float(v)) for m, v in points]}), RuntimeConfig())
    assert [(r.started_at_ms // MINUTE, r.ended_at_ms and r.ended_at_ms // MINUTE)
            for r in got.collect()] == expected


def test_stored_rates_give_the_same_sessions(spark):
    rng = random.Random(9)
    cfg = RuntimeConfig()
    readings = frame(spark, {f"d{n}": random_series(rng, False) for n in range(20)})
    stored = detect_sessions(with_rates(readings, cfg), cfg, stored_rates=True)
    computed = detect_sessions(readings, cfg)
    assert sorted(stored.collect()) == sorted(computed.collect())


@pytest.mark.parametrize("seed", [21, 22])
def test_active_devices_are_those_with_an_open_session(spark, seed):
    rng = random.Random(seed)
    cfg = RuntimeConfig(start_samples=seed % 2 + 1, end_hold_min=20)
    readings = frame(spark, {f"d{n}": random_series(rng, ties=True) for n in range(80)})
    active = {r.device_id for r in active_devices(readings, cfg).collect()}
    assert active == {r.device_id for r in open_sessions(detect_sessions(readings, cfg)).collect()}
    assert 0 < len(active) < 80


def test_open_and_recent_sessions(spark):
    sessions = detect_sessions(frame(spark, {
        "closed": [(0, None, 80.0), (5 * MINUTE, None, 80.0), (60 * MINUTE, None, 10.0)],
        "open": [(MINUTE, None, 80.0), (6 * MINUTE, None, 80.0)],
    }), RuntimeConfig())
    assert [r.device_id for r in open_sessions(sessions).collect()] == ["open"]
    assert any_open_session(sessions)
    assert [r.started_at_ms for r in sessions_since(sessions, 0).collect()] == [0, MINUTE]
    assert sessions_since(sessions, 2 * MINUTE).isEmpty()


def test_gap_segments_keep_an_equal_gap(spark):
    rows = frame(spark, {"d": [(0, None, None), (10, None, None), (21, None, None)]})
    got = gap_segments(rows, 10, ("device_id",), ("observed_at_ms",))
    assert [r.segment for r in got.orderBy("observed_at_ms").collect()] == [0, 0, 1]


def test_one_shuffle_of_the_readings_for_rates_and_sessions(spark):
    readings = frame(spark, {"d": [(0, None, 80.0)]})
    plan = detect_sessions(readings, RuntimeConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(device_id") == 2  # the second: one row per stretch
    assert "PythonUDF" not in plan
