"""Reading device messages: JSON values of unknown shape, kept as VARIANT.

A VARIANT keeps the difference between a number, a numeric string and a boolean, and between a
missing key and a JSON null, all of which matter here.  Objects are opened with one cast to the
struct of the wanted keys: the cast is null for anything that is not an object, a field is SQL null
only when its key is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: white space that may surround a numeric string.
_SPACE = r"[\s   -     　﻿]"
_PADDING = f"^{_SPACE}+|{_SPACE}+$"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_HEX = r"^0[xX][0-9a-fA-F]+$"
_OCTAL = r"^0[oO][0-7]+$"
_BINARY = r"^0[bB][01]+$"

# Fixed value: prefixes of the correlation ids that identify an uplink.
UPLINK_ID_PREFIXES = ("gs:uplink:", "as:up:")


def opened(value: Column, *keys: str) -> Column:
    """The named keys of a JSON object as a struct of VARIANTs; null if it is not an object."""
    fields = ", ".join(f"{key} variant" for key in keys)
    return F.try_variant_get(value, "$", f"struct<{fields}>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def elements(value: Column) -> Column:
    """The elements of a JSON array, null if it is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def text(value: Column) -> Column:
    """A JSON string, null for any other kind of value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def nonempty_text(value: Column) -> Column:
    return F.nullif(text(value), F.lit(""))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and the expression built once, however often it is mentioned."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def numeric_text(raw: Column) -> Column:
    """The number a string spells, null when it spells none."""
    return _bound(F.regexp_replace(raw, _PADDING, ""), lambda bare: (
        F.when(bare.rlike(_DECIMAL), bare.try_cast("double"))
        .when(bare.rlike(_HEX), _of_base(bare, 4))
        .when(bare.rlike(_OCTAL), _of_base(bare, 3))
        .when(bare.rlike(_BINARY), _of_base(bare, 1))
    ))


def _of_base(prefixed: Column, bits: int) -> Column:
    """Nearest double of prefixed digits of ``bits`` bits each, however many there are.

    The first 57 bits or more decide the value; whether anything follows them only matters where
    they lie half-way between two doubles, so it is kept as their lowest bit.
    """
    kept = 60 // bits

    def value(digits: Column) -> Column:
        rest = F.substring(digits, kept + 1, 1 << 30)
        head = F.conv(F.substring(digits, 1, kept), 1 << bits, 10).cast("bigint")
        sticky = head.bitwiseOR(F.when(rest.rlike("[1-9a-fA-F]"), 1).otherwise(0).cast("bigint"))
        return F.when(digits == "", 0.0).otherwise(
            sticky.cast("double") * F.pow(F.lit(2.0), F.length(rest) * bits))

    return _bound(F.regexp_replace(F.substring(prefixed, 3, 1 << 30), "^0+", ""), value)


def finite(value: Column) -> Column:
    """A finite number from a JSON number or numeric string; booleans and the rest are null."""
    kind = F.schema_of_variant(value)
    number = (
        F.when(kind == "STRING", numeric_text(F.try_variant_get(value, "$", "string")))
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
              F.try_variant_get(value, "$", "double"))
    )
    return _bound(number, lambda x: F.when(F.abs(x) < F.lit(float("inf")), x))


def finite_numbers(*values: Column) -> Column:
    """``finite`` of several values as an array; the expression is built once for all of them."""
    return F.transform(F.array(*values), finite)


def whole(number: Column) -> Column:
    """A number without a fraction as a whole number, else null."""
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def integral(value: Column) -> Column:
    """A finite number without a fraction, else null."""
    return _bound(finite(value), whole)


def hex_identity(raw: Column) -> Column:
    """Device EUI: hexadecimal digits only, upper case, null when nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(raw, "[^0-9a-fA-F]", "")), F.lit(""))


def application_message(value: Column) -> Column:
    """The message itself, bare or inside a ``data`` or ``result`` wrapper; null when there is none."""
    outer = opened(value, "uplink_message", "data", "result")
    return (
        F.when(is_object(outer.uplink_message), value)
        .when(is_object(opened(outer.data, "uplink_message").uplink_message), outer.data)
        .when(is_object(opened(outer.result, "uplink_message").uplink_message), outer.result)
    )


def has_temperature_key(message: Column) -> Column:
    uplink = opened(message, "uplink_message").uplink_message
    decoded = opened(opened(uplink, "decoded_payload").decoded_payload,
                     "Temp_Channel1", "Temp_Channel2")
    return decoded.Temp_Channel1.isNotNull() | decoded.Temp_Channel2.isNotNull()


def chosen_message(body: Column) -> Column:
    """One message per body: of an array the first with a temperature key, else the first at all."""
    candidates = F.filter(F.transform(elements(body), application_message),
                          lambda message: message.isNotNull())
    return F.coalesce(
        application_message(body),
        F.try_element_at(F.filter(candidates, has_temperature_key), F.lit(1)),
        F.try_element_at(candidates, F.lit(1)),
    )


def strongest_reception(receptions: Column) -> Column:
    """Struct (rssi, snr) of the reception with the greatest rssi, the first one on a tie."""
    heard = F.filter(
        F.transform(elements(receptions), lambda entry: _bound(opened(entry, "rssi", "snr"), lambda e: _bound(
            finite_numbers(e.rssi, e.snr), lambda both: F.struct(both[0].alias("rssi"), both[1].alias("snr"))))),
        lambda entry: entry.rssi.isNotNull(),
    )
    nothing = F.lit(None).cast("struct<rssi:double,snr:double>")
    return F.aggregate(heard, nothing, lambda best, entry: F.when(
        best.isNull() | (entry.rssi > best.rssi), entry).otherwise(best))


def uplink_id(correlation_ids: Column) -> Column:
    """The first correlation id that names an uplink, null when none does."""
    named = F.filter(F.transform(elements(correlation_ids), text), lambda item: (
        item.startswith(UPLINK_ID_PREFIXES[0]) | item.startswith(UPLINK_ID_PREFIXES[1])))
    return F.try_element_at(named, F.lit(1))


def message_key(named: Column, eui: Column, device: Column, session: Column,
                counter: Column, received_at: Column) -> Column:
    """The uplink's own id, else one composed of device, session and counter."""
    composed = F.concat_ws(":", F.coalesce(eui, device), F.coalesce(session, received_at),
                           F.coalesce(counter.cast("string"), received_at))
    return F.coalesce(named, composed)


def evaluated(value: Column) -> Column:
    """The value as the only row of a generator.

    Filters and later projections are not pushed through a generator, so an expensive value that
    they mention several times is still computed once per row.
    """
    return F.explode(F.array(value))
