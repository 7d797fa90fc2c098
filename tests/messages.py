"""Device messages put together from parts; all names, numbers and times are invented."""

import copy
import json

EUI = "0C11AE0000F00D07"
PARTS = {
    "at": "2031-03-11T18:40:05.250Z", "key": "gs:uplink:m-17", "session": "k-7", "counter": 903,
    "first": 18.75, "second": 311.5, "eui": " ".join(EUI[i:i + 2].lower() for i in range(0, 16, 2)),
}
# The second gateway hears the device best.
RECEPTIONS = [{"rssi": -103.5, "snr": -4}, {"rssi": -48, "snr": 11.25}, {"rssi": -77, "snr": 3}]


def identity(parts):
    return {"device_id": "kiln-3", "application_ids": {"application_id": "field"}, "dev_eui": parts["eui"]}


def measured(parts):
    return {"BatV": 3.125, "Temp_Channel1": parts["first"], "Temp_Channel2": parts["second"]}


def link(parts):
    return {"f_cnt": parts["counter"], "f_port": 2, "session_key_id": parts["session"],
            "decoded_payload": measured(parts), "rx_metadata": copy.deepcopy(RECEPTIONS)}


def uplink(**changes):
    """A message; changes are parts by name, or whole top-level members."""
    parts = {name: changes.pop(name, value) for name, value in PARTS.items()}
    whole = {"received_at": parts["at"], "correlation_ids": [parts["key"]],
             "end_device_ids": identity(parts), "uplink_message": link(parts)}
    return whole | changes


def with_payload(message, **payload):
    message = copy.deepcopy(message)
    message["uplink_message"]["decoded_payload"] = payload
    return message


def text(value):
    return json.dumps(value)
