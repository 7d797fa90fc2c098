import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from emberline import RuntimeConfig
from emberline.functions import moments, numeric as N
from emberline.operators import current, heat, history as H, months

MINUTE = 60_000
HOUR = 60 * MINUTE
NOW = 1_801_000_000_000


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def numbers(spark, function, cases):
    frame = spark.createDataFrame([(float(x) if x is not None else None,) for x in cases], "x double")
    return [r[0] for r in frame.select(function(F.col("x"))).collect()]


def test_rounding(spark):
    cases = {2.5: 3.0, -2.5: -2.0, 0.49999999999999994: 0.0, 1e300: 1e300, -0.4: 0.0}
    assert numbers(spark, lambda x: N.half_up(x, 0), cases) == list(cases.values())
    assert numbers(spark, lambda x: N.half_up(x, 2), [1.005, 2.675, 1.255, None, float("nan"), float("inf")]) == [
        1.0, 2.68, 1.25, None, None, None]


def test_means_do_not_depend_on_the_order(spark):
    """The mean is that of exact fractions, rounded once, and is published as it is."""
    rng = random.Random(6)
    series = [[20.0049999999995], [20.005, 20.005, 20.005], [1e15, 0.1, -1e15], [rng.uniform(-40, 600) for _ in range(5_000)],
              [0.1] * 10, [1e-9, -3e-9], [2.0**60, 1.0]]
    for values in series:
        expected = float(sum(map(Fraction, values)) / len(values))
        for n in (1, 7):
            rows = rng.sample(values, len(values))
            got = spark.createDataFrame([(x,) for x in [*rows, None]], "x double").repartition(n).agg(N.exact_mean(F.col("x")).alias("m")).first().m
            assert got == pytest.approx(expected, rel=4e-16, abs=1e-21)
    one = spark.createDataFrame([(20.0049999999995,)], "x double").agg(N.exact_mean(F.col("x")).alias("m"))
    assert one.select(N.temperature(F.col("m"), "c")).first()[0] == 20.0
    odd = spark.createDataFrame([(1e300, 1.0, None), (3e300, float("inf"), None)], "a double, b double, c double")
    assert odd.agg(*[N.exact_mean(F.col(c)) for c in "abc"]).first()[:] == (2e300, float("inf"), None)


def test_fixed_text(spark):
    cases = {0.25: "0.3", 0.15: "0.1", 0.35: "0.3", -0.04: "-0.0", -2.16: "-2.2", 307.2: "307.2",
             99.95: "100.0", 0.0: "0.0", None: "—", float("inf"): "—"}
    assert numbers(spark, lambda x: N.fixed(x, 1), cases) == list(cases.values())
    assert numbers(spark, lambda x: N.fixed(x, 0), [77.5, 391.4, None]) == ["78", "391", "—"]


def test_units(spark):
    assert value(spark, N.c_rate_to_f(F.lit(2.0))) == 3.6
    assert value(spark, N.temperature(F.lit(31.7), "f")) == 89.06
    assert [N.requested_unit(u) for u in ("C", "c", "f", "k", None)] == ["c", "c", "f", "f", "f"]


def test_settings():
    cfg = RuntimeConfig.from_settings({"SAUNA_CHANNEL": "2", "STOVEPIPE_CHANNEL": "1", "RATE_WINDOW_MINUTES": "5",
                                       "EXPECTED_INTERVAL_SECONDS": "-1", "EXPECTED_DEV_EUI": "0c 11",
                                       "SESSION_END_HOLD_MINUTES": "x", "REPORT_TIME_ZONE": ""})
    assert (cfg.air_channel, cfg.heater_channel, cfg.rate_span_min, cfg.expected_interval_s) == (2, 1, 5, 300)
    assert (cfg.hold_ms, cfg.stale_after_s, cfg.max_gap_ms) == (45 * MINUTE, 1_200, 750_000)
    assert (cfg.time_zone, cfg.dev_eui, cfg.application_id) == ("America/New_York", "0C11", None)
    for bad in ({"SAUNA_CHANNEL": "2"}, {"SESSION_END_PIPE_C": "75"}):
        with pytest.raises(ValueError):
            RuntimeConfig.from_settings(bad)


def test_ranges_and_buckets():
    assert H.history_range("all") == ("all", None)
    assert H.history_range("90d") == H.history_range(None) == ("24h", 24 * HOUR)
    interval = 5 * MINUTE
    for name, expected in (("1h", 5), ("3h", 5), ("12h", 5), ("24h", 5), ("7d", 15), ("30d", 60)):
        assert H.history_bucket_ms(name, 0, interval) == expected * MINUTE
    assert H.history_bucket_ms("7d", 0, HOUR) == HOUR
    assert H.history_bucket_ms("all", 30 * 24 * HOUR, interval) == HOUR
    assert H.history_bucket_ms("all", 10**15, interval) == 7 * 24 * HOUR


def test_history_of_known_readings(spark):
    rows = [(NOW - m * MINUTE, a, h, None, r) for m, a, h, r in (
        (60, 20.0, 100.0, None), (59, 21.0, 102.0, 0.5), (30, None, 90.0, 1.0), (0, 30.0, 95.0, None), (-1, 99.0, 99.0, 9.0))]
    readings = spark.createDataFrame(rows, "observed_at_ms long, sauna_temp_c double, stovepipe_temp_c double, "
                                     "sauna_rate_c_per_min double, stovepipe_rate_c_per_min double")
    got = H.history(readings, "1h", NOW, RuntimeConfig(), "c").orderBy("series", "ts").collect()
    assert [(r.series, r.temp, r.temp_min, r.temp_max, r.rate, r.segment) for r in got] == [
        ("Sauna air", 20.5, 20.0, 21.0, None, 0), ("Sauna air", 30.0, 30.0, 30.0, None, 1),
        ("Stovepipe", 101.0, 100.0, 102.0, 0.5, 0), ("Stovepipe", 90.0, 90.0, 90.0, 1.0, 1),
        ("Stovepipe", 95.0, 95.0, 95.0, None, 2)]
    empty = H.history(readings.limit(0), "all", NOW, RuntimeConfig())
    assert empty.isEmpty()


def test_readouts(spark):
    points = spark.createDataFrame([(61.3, 61.3, -0.055), (60.0, 72.5, None)],
                                   "temp_min double, temp_max double, rate double")
    got = H.history_readouts(points).collect()
    assert got[0].rate_per_hour == pytest.approx(-3.3)
    assert [(r.temperature_readout, r.rate_readout) for r in got] == [
        ("61.3 °F", "-3.3 °F/hour"), ("60.0–72.5 °F", None)]
    assert H.with_valid_rate(points).count() == 1


@pytest.mark.parametrize(("changes", "expected"), [
    ({"current": 150.0}, ("hot", "HOT", "")),
    ({}, ("eta", "2H", "1:15 PM")),
    ({"later": 4 * MINUTE}, ("eta", "2H", "1:15 PM")),
    ({"current": 101.0}, ("eta", "1H 40M", "12:50 PM")),
    ({"current": 149.9}, ("eta", "5M", "11:15 AM")),
    ({"rate": 0.02}, ("warming", "WARMING", "CALCULATING")),
    ({"rate": 0.06}, ("warming", "WARMING", "CALCULATING")),
    ({"rate": 0.0}, ("heating", "HEATING", "CALCULATING")),
    ({"rate": -0.3}, ("cooling", "COOLING", "")),
    ({"rate": None, "active": False}, ("idle", "NOT HEATING", "")),
    ({"status": "delayed"}, ("unavailable", "—", "UNAVAILABLE")),
    ({"current": None}, ("unavailable", "—", "UNAVAILABLE")),
])
def test_heat_status(spark, changes, expected):
    case = {"current": 90.0, "rate": 0.5, "status": "live", "active": True, "later": 0, **changes}
    observed = value(spark, moments.epoch_ms(F.lit("2027-02-03T10:12:00Z")))
    got = value(spark, heat.heat_status(
        F.lit(case["current"]).cast("double"), F.lit(case["rate"]).cast("double"), F.lit(observed),
        F.lit(case["status"]), F.lit(case["active"]), 150, observed + case["later"], "Europe/Berlin"))
    assert tuple(got) == expected


def test_freshness_and_snapshot(spark):
    cfg = RuntimeConfig()
    ages = {-5: "live", 600: "live", 601: "delayed", 1200: "delayed", 1201: "stale"}
    frame = spark.createDataFrame([(NOW - s * 1_000,) for s in ages], "t long")
    assert [r[0] for r in frame.select(current.freshness(F.col("t"), NOW, cfg)).collect()] == list(ages.values())
    rows = spark.createDataFrame([("d", NOW, 37.25, 201.5), ("e", NOW, None, 201.5)],
                                 "device_id string, observed_at_ms long, sauna_temp_c double, stovepipe_temp_c double")
    assert [(r.sauna_f, r.stovepipe_f) for r in current.display_snapshot(rows).collect()] == [("99", "395"), ("—", "395")]


def test_months(spark):
    assert [months.month_count(x) for x in (12, "36", 99, 0, 1.5, "x", None, "", float("nan"))] == [
        12, 36, 36, 1, 12, 12, 12, 1, 12]
    zone = "America/New_York"
    march_first = value(spark, moments.epoch_ms(F.lit("2024-03-01T03:00:00Z")))  # still February there
    spine = months.month_spine(spark, 14, march_first, zone).collect()
    assert (spine[0].month, spine[-1].month, spine[-1].label, spine[-1].partial) == ("2023-01", "2024-02", "Feb 2024", True)
    sessions = spark.createDataFrame([
        (march_first - 28 * 24 * HOUR, march_first - 28 * 24 * HOUR + 90 * MINUTE, 1),
        (march_first - HOUR, None, 0), (march_first + HOUR, None, 0), (0, 1, 1)],
        "started_at_ms long, ended_at_ms long, complete int")
    got = {r.month: r for r in months.sessions_by_month(sessions, 2, march_first, zone).collect()}
    assert set(got) == {"2024-01", "2024-02"}
    january, february = got["2024-01"], got["2024-02"]
    assert (january.sessions, january.total_hours, january.average_duration_minutes) == (0, 0.0, None)
    assert (february.sessions, february.total_hours, february.average_duration_minutes,
            february.complete_sessions) == (3, 2.5, 50.0, 1)


def test_long_form_is_complete_for_random_buckets(spark):
    rng = random.Random(3)
    rows = [(NOW - rng.randint(0, 7 * 24 * HOUR), rng.choice([None, rng.uniform(0, 90)]), rng.uniform(0, 300), None, None)
            for _ in range(3_000)]
    readings = spark.createDataFrame(rows, "observed_at_ms long, sauna_temp_c double, stovepipe_temp_c double, "
                                     "sauna_rate_c_per_min double, stovepipe_rate_c_per_min double")
    got = H.history(readings, "7d", NOW, RuntimeConfig(), "c")
    width = 15 * MINUTE
    for label, column in (("Sauna air", 1), ("Stovepipe", 2)):
        buckets = {r[0] // width for r in rows if r[column] is not None}
        assert got.where(F.col("series") == label).count() == len(buckets)
