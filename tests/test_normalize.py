import json
import math

import pytest
from messages import EUI, text, uplink, with_payload
from pyspark.sql import functions as F

from emberline import RuntimeConfig
from emberline.functions import envelope as E
from emberline.functions.moments import epoch_ms
from emberline.operators import normalize as M
from emberline.operators.dedupe import (
    dedupe_first, frame_counter_reuse, latest_of, monotone_latest, new_rows_only, reading_signature,
)
from emberline.sources.messages import LARGEST_MESSAGE, parsable, unparsable, with_body

CFG = RuntimeConfig()


def parse(spark, bodies, cfg=CFG):
    rows = [(n, body if isinstance(body, str) else json.dumps(body)) for n, body in enumerate(bodies)]
    frame = with_body(spark.createDataFrame(rows, "n int, value string"))
    return M.normalize_uplinks(frame, cfg).orderBy("n").collect()


def test_outcomes(spark):
    status = with_payload(uplink(), BatV=3.6)
    second = uplink(key="gs:uplink:m-18")
    null_key = with_payload(uplink(key="gs:uplink:null"), Temp_Channel1=None)
    no_application = uplink(end_device_ids={"device_id": "d", "application_ids": {}})
    cases = [
        (uplink(), "gs:uplink:m-17"),
        ({"data": uplink()}, "gs:uplink:m-17"),
        ({"result": uplink()}, "gs:uplink:m-17"),
        ([{"data": status}, {"data": second}], "gs:uplink:m-18"),
        ([5, None, {"data": status}], M.NO_TEMPERATURE),
        ([{"data": null_key}, {"data": second}], M.NO_TEMPERATURE),
        (status, M.NO_TEMPERATURE),
        ({"uplink_message": 5}, M.NO_MESSAGE),
        ([], M.NO_MESSAGE),
        ("null", M.NO_MESSAGE),
        ({"uplink_message": {}}, M.NO_UPLINK),
        ({"uplink_message": {}, "end_device_ids": {}}, M.NO_PAYLOAD),
        (uplink(at="not-a-time"), M.BAD_TIME),
        (uplink(at=1), M.BAD_TIME),
        (no_application, M.NO_IDENTITY),
        (with_payload(uplink(), Temp_Channel1=True, Temp_Channel2="x"), M.NO_TEMPERATURE),
    ]
    for (_, expected), row in zip(cases, parse(spark, [c for c, _ in cases]), strict=True):
        assert (row.reading.message_key if row.reading else row.reason) == expected
        assert row.outcome == ("reading" if row.reading else
                               "error" if expected in (M.BAD_TIME, M.NO_IDENTITY) else "ignored")


def test_reading_fields(spark):
    reading = parse(spark, [uplink()])[0].reading
    assert reading.asDict() == {
        "message_key": "gs:uplink:m-17", "observed_at_ms": 1931020805250,
        "received_at": "2031-03-11T18:40:05.250Z", "application_id": "field", "device_id": "kiln-3",
        "dev_eui": EUI, "session_key_id": "k-7", "f_port": 2, "frame_counter": 903,
        "temp_channel_1_c": 18.75, "temp_channel_2_c": 311.5, "sauna_temp_c": 18.75,
        "stovepipe_temp_c": 311.5, "battery_v": 3.125, "rssi_dbm": -48.0, "snr_db": 11.25}


def test_one_probe_and_swapped_channels(spark):
    one = parse(spark, [with_payload(uplink(), Temp_Channel2=120)])[0].reading
    assert (one.sauna_temp_c, one.stovepipe_temp_c) == (None, 120.0)
    swapped = parse(spark, [uplink()], RuntimeConfig(air_channel=2, heater_channel=1))[0].reading
    assert (swapped.sauna_temp_c, swapped.stovepipe_temp_c) == (311.5, 18.75)


@pytest.mark.parametrize(("changes", "key"), [
    ({"correlation_ids": ["x", 5, "as:up:1", "gs:uplink:2"]}, "as:up:1"),
    ({"correlation_ids": "gs:uplink:2"}, f"{EUI}:k-7:903"),
    ({"correlation_ids": [], "session": None, "counter": 1.5},
     f"{EUI}:2031-03-11T18:40:05.250Z:2031-03-11T18:40:05.250Z"),
    ({"correlation_ids": [], "eui": "zz"}, "kiln-3:k-7:903"),
])
def test_message_key(spark, changes, key):
    assert parse(spark, [uplink(**changes)])[0].reading.message_key == key


@pytest.mark.parametrize(("receptions", "expected"), [
    ([{"rssi": -80, "snr": 1}, {"rssi": -80, "snr": 9}], (-80.0, 1.0)),
    ([5, {"rssi": "x"}, {"rssi": "-70"}], (-70.0, None)),
    ({"rssi": -70}, (None, None)),
    ([], (None, None)),
])
def test_strongest_reception(spark, receptions, expected):
    frame = spark.createDataFrame([(json.dumps(receptions),)], "j string")
    got = frame.select(E.strongest_reception(F.try_parse_json("j")).alias("r")).first().r
    assert ((got.rssi, got.snr) if got else (None, None)) == expected


def test_finite_numbers(spark):
    cases = {
        "1": 1.0, "-2.5e1": -25.0, '"1.5"': 1.5, '" 7 "': 7.0, '"1e3"': 1000.0, '".5"': 0.5, '"5."': 5.0,
        '"0x10"': 16.0, '"0x1234567890abcdef0"': float(0x1234567890ABCDEF0), '"0x00"': 0.0,
        '"0x100000000000008000000000001"': float(0x100000000000008000000000001),
        '"0x10000000000000800000000000000"': float(0x10000000000000800000000000000),
        '"0b1111111111111111111111111111111111111111111111111111111111111111111111"': float(2**70 - 1), '"0o7777777777777777777777777"': float(8**25 - 1),
        '"0xffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffffff"': None, '"0b11"': 3.0, '"0o17"': 15.0, "true": None, '"true"': None, '""': None,
        '"  "': None, "null": None, '"NaN"': None, '"Infinity"': None, '"1.5d"': None, '"1_0"': None,
        "[1]": None, '{"a": 1}': None, "1e999": None, "12345678901234567890": 1.2345678901234567e19,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "j string")
    got = frame.select("j", E.finite(F.try_parse_json("j")).alias("x")).collect()
    assert {r.j: r.x for r in got} == cases


def test_instants(spark):
    cases = {
        "2031-03-11T18:40:05.250Z": 1931020805250, "2031-03-11T18:40:05.250999999Z": 1931020805250,
        "2031-03-11T23:10:05+04:30": 1931020805000, "2031-03-11T18:40:05": 1931020805000,
        "2031-03-11 18:40:05Z": 1931020805000, "2031-03-11": 1930953600000, "2031-03": 1930089600000,
        "2031": 1924992000000, "1969-12-31T23:59:59.998Z": -2, "soon": None, "": None,
        "2031-14-01": None, "2031-03-11T24:30:00Z": None, " 2031-03-11": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.ms for r in frame.select("s", epoch_ms(F.col("s")).alias("ms")).collect()} == cases


def test_expected_source(spark):
    rows = [(text(uplink()),), (text(uplink(eui="01")),), (text(with_payload(uplink(), BatV=1)),)]
    frame = with_body(spark.createDataFrame(rows, "value string"))
    def reasons(**settings):
        cfg = RuntimeConfig(**settings)
        return [r.reason for r in M.expect_source(M.normalize_uplinks(frame, cfg), cfg).collect()]
    assert reasons() == [None, None, M.NO_TEMPERATURE]
    assert reasons(dev_eui=EUI) == [None, M.OTHER_DEVICE, M.NO_TEMPERATURE]
    assert reasons(application_id="other") == [M.OTHER_APPLICATION] * 2 + [M.NO_TEMPERATURE]


def test_unreadable_messages(spark):
    rows = [("{}",), ("{",), ('"' + "x" * LARGEST_MESSAGE + '"',), ('{"a":1,"a":2}',)]
    frame = with_body(spark.createDataFrame(rows, "value string"))
    assert parsable(frame).count() == 2
    assert sorted(r.problem for r in unparsable(frame).collect()) == [
        "Message is not valid JSON", "Message is too large"]


def test_first_row_of_a_key_is_stored(spark):
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "message_key string, n int")
    assert sorted(map(tuple, dedupe_first(batch, "message_key", ("n",)).collect())) == [("a", 1), ("b", 1)]
    stored = spark.createDataFrame([("a",)], "message_key string")
    assert [r.message_key for r in new_rows_only(batch, stored).collect()] == ["b"]
    assert "WindowGroupLimit" in dedupe_first(
        batch, "message_key", ("n",))._jdf.queryExecution().executedPlan().toString()


def test_signature_separates_null_and_value(spark):
    readings = M.readings_of(M.normalize_uplinks(with_body(spark.createDataFrame(
        [(text(uplink(session=s)),) for s in (None, "", "null", "x", "x")], "value string")), CFG))
    signatures = [r[0] for r in readings.select(reading_signature()).collect()]
    assert len(set(signatures)) == 3  # an empty session id is no session id


def test_counter_reuse_needs_another_time(spark):
    rows = [("E", "d", 7, "t1"), ("E", "d", 7, "t1"), ("E", "d", 8, "t1"), ("E", "d", 8, "t2"),
            (None, "d", 9, "t1"), (None, "d", 9, "t2")]
    got = frame_counter_reuse(spark.createDataFrame(
        rows, "dev_eui string, device_id string, frame_counter long, received_at string")).collect()
    assert [(r.frame_counter, r.timestamps) for r in got] == [(8, 2)]


def test_latest_never_goes_back(spark):
    schema = "device_id string, observed_at_ms long, message_key string"
    held = spark.createDataFrame([("a", 5, "a5"), ("b", 5, "b5"), ("e", None, "e")], schema)
    incoming = spark.createDataFrame(
        [("a", 5, "a5-again"), ("b", 4, "b4"), ("c", 1, "c1"), ("b", None, "x"), ("e", 1, "e1")], schema)
    got = {r.device_id: r.message_key for r in monotone_latest(held, incoming).collect()}
    assert got == {"a": "a5-again", "b": "b5", "c": "c1", "e": "e1"}
    assert latest_of(incoming.where("observed_at_ms > 0"), ()).first().message_key == "a5-again"
    assert latest_of(incoming).where("device_id = 'b'").first().message_key == "b4"


def test_nothing_is_infinite(spark):
    got = spark.range(1).select(E.numeric_text(F.lit("1e999")).alias("x")).first().x
    assert math.isinf(got)
