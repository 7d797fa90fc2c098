"""Audit of archived messages before they are replayed.

Row rules and the normaliser give every line a status, duplicates and conflicts are decided in line
order, a live baseline is reconciled, and a clean audit yields the replay set.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import RuntimeConfig
from emberline.functions import envelope as E
from emberline.functions.moments import epoch_ms
from emberline.operators.claims import turned_away
from emberline.operators.dedupe import frame_counter_reuse, packet_sha256, reading_signature
from emberline.operators.normalize import NO_PAYLOAD, NO_TEMPERATURE, message_fields, reading_columns
from emberline.session import cut_lineage
from emberline.sources.pages import is_blank

# Default plausible ranges, places without a file and the reported reasons.
AIR_RANGE_C = (-40.0, 150.0)
HEATER_RANGE_C = (-40.0, 600.0)
ALL_INPUTS = "<all inputs>"
LIVE_BASELINE = "<live baseline>"
NOT_JSON = "Line is not valid JSON"
NOT_WRAPPED = "Line must contain exactly one {result: ApplicationUp} storage wrapper"
WRONG_APPLICATION = "Unexpected or missing application identifier"
NO_DEVICE = "Missing device identifier"
WRONG_EUI = "Unexpected or missing device EUI"
BAD_TIME = "Missing or invalid received_at timestamp"
OUT_OF_BOUNDS = "received_at falls outside the exclusive audit bounds"
NOT_FINITE = " is present but is not a finite number"
IMPLAUSIBLE = "Temperature falls outside the configured plausible range"
KEY_CONFLICT = "Message key conflicts with different normalized data"
KEY_DUPLICATE = "Exact normalized message-key duplicate"
PACKET_CONFLICT = "Physical packet tuple appears under multiple message keys"
TIME_CONFLICT = "Device has multiple distinct messages at the same received_at timestamp"
NO_EVENTS = "No storage events were found"
ROW_NOT_OBJECT = "Live baseline row is not an object"
ROW_INCOMPLETE = ("Live baseline row lacks the exact identity or finite raw-channel fields required"
                  " for reconciliation")
ROW_KEY_REPEATED = "Live baseline repeats a message key"
ROW_PACKET_REPEATED = "Live baseline contains multiple rows for the same exact physical event"
LIVE_KEY_CONFLICT = "Live message key conflicts with a different archive event"
LIVE_VALUE_CONFLICT = "Live/archive physical-event match has different raw channel values"
LIVE_OVERLAP = "Exact live/archive physical-event overlap; preserve the live representation"

READING_FIELDS = (
    "application_id", "device_id", "dev_eui", "session_key_id", "f_port", "frame_counter",
    "temp_channel_1_c", "temp_channel_2_c", "sauna_temp_c", "stovepipe_temp_c", "battery_v",
    "rssi_dbm", "snr_db",
)
PLACE = "struct<source_file:string,source_line:bigint>"


@dataclass(frozen=True)
class AuditOptions:
    """What the archive is expected to hold; ``dev_eui`` None accepts any device that has one."""

    after_ms: float
    before_ms: float
    expected_count: int
    application_id: str
    dev_eui: str | None = None
    air_range_c: tuple[float, float] = AIR_RANGE_C
    heater_range_c: tuple[float, float] = HEATER_RANGE_C
    channels: RuntimeConfig = RuntimeConfig(air_channel=2, heater_channel=1)

    def __post_init__(self) -> None:
        def increasing(low: float, high: float) -> bool:
            return math.isfinite(low) and math.isfinite(high) and low < high

        if not increasing(self.after_ms, self.before_ms):
            raise ValueError("The audit timestamp bounds must be finite and increasing")
        if self.expected_count != int(self.expected_count) or self.expected_count < 0:
            raise ValueError("The expected event count must be a non-negative whole number")
        for label, bounds in (("air", self.air_range_c), ("heater", self.heater_range_c)):
            if not increasing(*bounds):
                raise ValueError(f"The {label} temperature range must be finite and increasing")


    def described(self) -> dict[str, object]:
        """The validation block of a manifest: what the archive was checked against."""
        def moment(ms: float) -> str:
            return datetime.fromtimestamp(ms / 1_000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")

        def span(bounds: tuple[float, float]) -> dict[str, float]:
            return {"minimum": float(bounds[0]), "maximum": float(bounds[1])}

        return {
            "expected_application_id": self.application_id, "expected_dev_eui": self.dev_eui or "any",
            "after_exclusive": moment(self.after_ms), "before_exclusive": moment(self.before_ms),
            "expected_storage_events": self.expected_count,
            "channel_mapping": {"sauna": f"Temp_Channel{self.channels.air_channel}",
                                "stovepipe": f"Temp_Channel{self.channels.heater_channel}"},
            "physical_identity": "dev_eui, device_id, exact received_at, frame_counter and raw channels",
            "frame_counter_only_deduplication": "not used",
            "sauna_range_c": span(self.air_range_c), "stovepipe_range_c": span(self.heater_range_c),
        }


def row_rules(lines: DataFrame, options: AuditOptions) -> DataFrame:
    """Status and reason of every non-blank line, and the reading of those that may be valid.

    The first rule that fails decides, except that each unusable channel is reported by itself.  A
    line whose wrapper also carries a bare or ``data`` message breaks the wrapper rule.
    ``status`` is null for lines that passed all rules.
    """
    df = lines.where(~is_blank()).select(
        F.col("file").alias("source_file"), F.col("line_no").alias("source_line"), "file_no",
        E.evaluated(F.try_parse_json("line")).alias("_body"))
    df = df.withColumn("_outer", E.opened(F.col("_body"), "uplink_message", "data", "result"))
    wrapped = E.is_object(E.opened(F.col("_outer.result"), "uplink_message").uplink_message)
    bare = (E.is_object(F.col("_outer.uplink_message"))
            | E.is_object(E.opened(F.col("_outer.data"), "uplink_message").uplink_message))
    df = df.withColumn("_wrapped", F.coalesce(wrapped & ~F.coalesce(bare, F.lit(False)), F.lit(False)))
    df = message_fields(df, F.col("_outer.result"), options.channels)
    reading = reading_columns(options.channels)

    def unusable(number: int) -> Column:
        return (F.col(f"_decoded.Temp_Channel{number}").isNotNull()
                & F.col(f"_channel_{number}").isNull())

    def outside(value: Column, bounds: tuple[float, float]) -> Column:
        return F.coalesce((value < bounds[0]) | (value > bounds[1]), F.lit(False))

    eui = F.col("_dev_eui")
    eui_fits = eui.isNotNull() if options.dev_eui is None else eui.eqNullSafe(F.lit(options.dev_eui))
    observed = F.col("_observed_at_ms")

    def verdicts(status: str | None, shows: str, *reasons: str | None) -> Column:
        return F.array(*[F.struct(F.lit(status).cast("string").alias("status"),
                                  F.lit(reason).cast("string").alias("reason"),
                                  F.lit(shows).alias("shows")) for reason in reasons])

    def failed(status: str, reason: str, shows: str) -> Column:
        return verdicts(status, shows, reason)

    result = (
        F.when(F.col("_body").isNull(), failed("error", NOT_JSON, "place"))
        .when(~F.col("_wrapped"), failed("error", NOT_WRAPPED, "place"))
        .when(~F.col("_application_id").eqNullSafe(F.lit(options.application_id)),
              failed("error", WRONG_APPLICATION, "place"))
        .when(F.col("_device_id").isNull(), failed("error", NO_DEVICE, "place"))
        .when(~eui_fits, failed("error", WRONG_EUI, "place"))
        .when(observed.isNull(), failed("error", BAD_TIME, "place"))
        .when((observed <= options.after_ms) | (observed >= options.before_ms),
              failed("error", OUT_OF_BOUNDS, "device"))
        .when(unusable(1) & unusable(2), verdicts("error", "device", *[
            f"Temp_Channel{number}{NOT_FINITE}" for number in (1, 2)]))
        .when(unusable(1), failed("error", "Temp_Channel1" + NOT_FINITE, "device"))
        .when(unusable(2), failed("error", "Temp_Channel2" + NOT_FINITE, "device"))
        .when(F.col("_decoded").isNull(), failed("ignored", NO_PAYLOAD, "source"))
        .when(F.col("_channel_1").isNull() & F.col("_channel_2").isNull(),
              failed("ignored", NO_TEMPERATURE, "source"))
        .when(outside(reading["sauna_temp_c"], options.air_range_c)
              | outside(reading["stovepipe_temp_c"], options.heater_range_c),
              failed("error", IMPLAUSIBLE, "reading"))
        .otherwise(verdicts(None, "reading", None))
    )
    df = df.select("*", F.posexplode(result).alias("part", "_result"))
    shows = F.col("_result.shows")
    whole = shows == "reading"

    def shown(name: str) -> Column:
        visible = {"device_id": shows != "place",
                   "application_id": shows.isin("source", "reading"),
                   "dev_eui": shows.isin("source", "reading")}
        return F.when(visible.get(name, whole), reading[name]).alias(name)

    return df.select(
        "file_no", "source_file", "source_line", "part", F.col("_result.status").alias("status"),
        F.col("_result.reason").alias("reason"),
        F.when(whole, reading["message_key"]).alias("message_key"),
        F.when(shows != "place", F.col("_received_at")).alias("observed_at"),
        F.when(whole, observed).alias("observed_at_ms"),
        *[shown(name) for name in READING_FIELDS],
        F.when(whole, reading["received_at"]).alias("received_at"),
        F.when(whole, F.to_json(F.col("_outer.result"))).alias("envelope"),
    )


def _place(file: str | Column, line: str | Column) -> Column:
    named = [c if isinstance(c, Column) else F.col(c) for c in (file, line)]
    return F.struct(named[0].alias("source_file"), named[1].cast("bigint").alias("source_line"))


def key_conflicts(parsed: DataFrame) -> DataFrame:
    """Verdicts on repeated message keys, packets and device times among lines that passed the rules.

    A packet names a device and its exact time text, so equal packets always share the device time:
    acceptance depends on message key and device time only.
    """
    rows = parsed.where("status IS NULL").select(
        "file_no", "source_line", "source_file",
        "message_key", F.struct("device_id", "observed_at_ms").alias("device_time"),
        packet_sha256(F.col("dev_eui"), F.col("device_id"), F.col("received_at"),
                      F.col("frame_counter")).alias("packet"),
        reading_signature().alias("signature"))
    # The order (file, line), then what is to be known about an accepted row.
    first = ("file_no", "source_line", "source_file", "packet", "signature")
    away = turned_away(rows, "message_key", "device_time", first)

    by_key = F.col("holder_a").isNotNull()
    same = F.col("holder_a.signature") == F.col("signature")
    by_packet = F.col("packet").isNotNull() & F.coalesce(
        F.col("holder_b.packet") == F.col("packet"), F.lit(False))
    holder = F.when(by_key, F.col("holder_a")).otherwise(F.col("holder_b"))
    return away.select(
        "file_no", "source_line",
        F.when(by_key & same, "duplicate").otherwise("error").alias("verdict"),
        F.when(by_key & same, KEY_DUPLICATE).when(by_key, KEY_CONFLICT)
        .when(by_packet, PACKET_CONFLICT).otherwise(TIME_CONFLICT).alias("verdict_reason"),
        _place(holder.getField("source_file"), holder.getField("source_line")).alias("duplicate_of"),
        by_key.alias("by_key"),
    )


def count_check(events: DataFrame, expected: int) -> DataFrame:
    """Records about the number of events: none when it is as expected and not zero."""
    total = events.agg(F.count("*").alias("_n"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_n") != expected, F.concat(
            F.lit("Storage event count "), F.col("_n").cast("string"),
            F.lit(f" does not match expected count {expected}"))),
        F.when(F.col("_n") == 0, NO_EVENTS)))
    return total.select(F.explode(reasons).alias("reason")).select(
        F.lit(ALL_INPUTS).alias("source_file"), F.lit(0).cast("bigint").alias("source_line"),
        F.lit("error").alias("status"), "reason")


def _baseline_record(reason: Column | str, duplicate_of: Column | None = None) -> list[Column]:
    none = F.lit(None).cast(PLACE)
    return [
        F.lit(LIVE_BASELINE).alias("source_file"), F.col("row_no").alias("source_line"),
        F.lit("error").alias("status"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        (none if duplicate_of is None else duplicate_of).alias("duplicate_of"),
    ]


def validate_baseline(baseline: DataFrame, options: AuditOptions) -> tuple[DataFrame, DataFrame]:
    """Usable baseline rows (one per message key and packet) and error records for the others."""
    row = E.opened(F.col("row"), "message_key", "application_id", "device_id", "dev_eui",
                   "received_at", "frame_counter", "temp_channel_1_c", "temp_channel_2_c")
    df = baseline.withColumn("_row", row)

    def channel(name: str) -> tuple[Column, Column]:
        value = F.col(f"_row.{name}")
        number = E.finite(value)
        return number, F.is_variant_null(value) | number.isNotNull()

    one, one_fits = channel("temp_channel_1_c")
    two, two_fits = channel("temp_channel_2_c")
    df = df.withColumns({
        "message_key": E.nonempty_text(F.col("_row.message_key")),
        "_application_id": E.text(F.col("_row.application_id")),
        "device_id": E.nonempty_text(F.col("_row.device_id")),
        "dev_eui": E.hex_identity(E.text(F.col("_row.dev_eui"))),
        "received_at": E.text(F.col("_row.received_at")),
        "frame_counter": E.integral(F.col("_row.frame_counter")),
        "temp_channel_1_c": one, "temp_channel_2_c": two, "_channels_fit": one_fits & two_fits,
    })
    eui_fits = (F.col("dev_eui").isNotNull() if options.dev_eui is None
                else F.col("dev_eui") == options.dev_eui)
    complete = F.coalesce(
        F.col("message_key").isNotNull() & (F.col("_application_id") == options.application_id)
        & F.col("device_id").isNotNull() & eui_fits & epoch_ms(F.col("received_at")).isNotNull()
        & F.col("frame_counter").isNotNull() & F.col("_channels_fit")
        & (F.col("temp_channel_1_c").isNotNull() | F.col("temp_channel_2_c").isNotNull()),
        F.lit(False))
    df = cut_lineage(df.select(
        "row_no", F.col("_row").isNotNull().alias("_is_object"), complete.alias("_complete"),
        "message_key", "temp_channel_1_c", "temp_channel_2_c",
        packet_sha256(F.col("dev_eui"), F.col("device_id"), F.col("received_at"),
                      F.col("frame_counter")).alias("packet")))

    complete_rows = df.where("_complete").drop("_is_object", "_complete")
    away = turned_away(complete_rows, "message_key", "packet", ("row_no",))
    by_key = F.col("holder_a").isNotNull()
    problems = df.where("NOT _complete").select(*_baseline_record(
        F.when(F.col("_is_object"), ROW_INCOMPLETE).otherwise(ROW_NOT_OBJECT))).unionByName(
        away.select(*_baseline_record(
            F.when(by_key, ROW_KEY_REPEATED).otherwise(ROW_PACKET_REPEATED),
            F.when(by_key, _place(F.lit(LIVE_BASELINE), F.col("holder_a.row_no"))))))
    return complete_rows.join(away, "row_no", "left_anti"), problems


def _same_channels(left: str, right: str) -> Column:
    return reduce(Column.__and__, [
        F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
        for name in ("temp_channel_1_c", "temp_channel_2_c")])


def baseline_key_conflicts(accepted: DataFrame, usable: DataFrame) -> DataFrame:
    """Baseline rows whose message key names another event in the archive."""
    same = F.col("a.packet").eqNullSafe(F.col("b.packet")) & _same_channels("a", "b")
    joined = usable.alias("b").join(accepted.alias("a"), F.col("a.message_key") == F.col("b.message_key"))
    return joined.where(~same).select(*_baseline_record(
        LIVE_KEY_CONFLICT, _place("a.source_file", "a.source_line")))


def baseline_matches(accepted: DataFrame, usable: DataFrame) -> DataFrame:
    """Accepted archive rows that are the same physical event as a baseline row."""
    return usable.alias("b").join(accepted.alias("a"), F.col("a.packet") == F.col("b.packet")).select(
        "a.file_no", "a.source_file", "a.source_line", "b.row_no",
        F.col("b.message_key").alias("live_message_key"), _same_channels("a", "b").alias("equal"))


@dataclass(frozen=True)
class Audit:
    """A finished audit: every frame is lazy and reads the stored parse of the lines and the small
    verdicts, so each use reads just the columns it needs; the payload is written once."""

    options: AuditOptions
    records: DataFrame          # one row per record of the manifest
    entries: DataFrame          # the same rows with file number, time and envelope
    accepted: DataFrame         # lines accepted after the conflict rules
    problems: DataFrame         # records that belong to no line
    baseline: DataFrame | None
    usable_baseline: DataFrame | None
    matches: DataFrame | None
    source_files: DataFrame | None = None

    def errors(self) -> int:
        return self.records.where("status = 'error'").count()

    def can_replay(self) -> bool:
        return self.records.where("status = 'error'").limit(1).isEmpty()

    def replay(self) -> DataFrame:
        """Envelopes to replay: accepted, not live already; none at all after any error."""
        valid = self.entries.where("status = 'valid'") if self.can_replay() else self.entries.limit(0)
        return valid.select("observed_at_ms", "device_id", "message_key", "received_at", "envelope")

    @staticmethod
    def replay_order() -> list[Column]:
        return [F.col("observed_at_ms"), F.collate("device_id", "UNICODE"),
                F.collate("message_key", "UNICODE")]

    def frame_counter_reuse(self) -> DataFrame:
        return frame_counter_reuse(self.accepted)

    def summary(self) -> DataFrame:
        """One row: counts by status, replay bounds and baseline coverage; a single lazy query.

        Every part contributes a row with its own figures, the rows are put together at the end.
        """
        position = F.struct("observed_at_ms", *[
            c.alias(n) for c, n in zip(self.replay_order()[1:], ("d", "k"), strict=True)])
        valid = F.col("status") == "valid"

        def figure(name: str) -> Column:
            return F.when(valid, F.col(name))

        parts = [
            self.entries.agg(
                F.count_if(F.col("part") == 0).alias("storage_events"),
                *[F.count_if(F.col("status") == status).alias(name) for name, status in (
                    ("valid", "valid"), ("live_overlaps", "live_overlap"), ("duplicates", "duplicate"),
                    ("ignored", "ignored"), ("errors", "error"))],
                F.min_by(figure("received_at"), F.when(valid, position)).alias("first_observed_at"),
                F.max_by(figure("received_at"), F.when(valid, position)).alias("last_observed_at")),
            self.problems.agg(F.count_if(F.col("status") == "error").alias("errors")),
            self.frame_counter_reuse().agg(F.count("*").alias("frame_counter_reuse_groups")),
        ]
        if self.matches is not None:
            parts += [
                self.baseline.agg(F.count("*").alias("baseline_rows")),
                self.usable_baseline.agg(F.count("*").alias("unmatched_rows")),
                self.matches.agg(F.count_if("equal").alias("matched_archive_rows"), (-F.count("*")).alias("unmatched_rows"))]
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        counts = ("storage_events", "valid", "live_overlaps", "duplicates", "ignored", "errors", "frame_counter_reuse_groups",
                  "baseline_rows", "matched_archive_rows", "unmatched_rows")
        whole = rows.agg(*[F.coalesce(F.sum(c) if c in rows.columns else F.lit(None), F.lit(0)).cast("bigint").alias(c) for c in counts],
                         F.max("first_observed_at").alias("first"), F.max("last_observed_at").alias("last"))
        clean = F.col("errors") == 0
        return whole.select(
            "storage_events", "valid", "live_overlaps", "duplicates", "ignored", "errors",
            F.when(clean, F.col("valid")).otherwise(0).alias("replay_envelopes"),
            F.when(clean, F.col("first")).alias("first_observed_at"), F.when(clean, F.col("last")).alias("last_observed_at"),
            "frame_counter_reuse_groups", F.lit(self.matches is not None).alias("baseline_supplied"), "baseline_rows",
            "matched_archive_rows", F.greatest(F.lit(0), F.col("unmatched_rows")).alias("unmatched_rows"))


def audit_pages(lines: DataFrame, options: AuditOptions, baseline: DataFrame | None = None,
                source_files: DataFrame | None = None) -> Audit:
    """Audit page lines (``file_no, file, line_no, line``) against an optional live baseline.

    Stored are the parsed lines, the verdicts on lines that conflict, the parsed baseline with its matches,
    and the records that belong to no line, so that no use joins archive and baseline again; the
    conflict rules work on keys alone and add a step for each round that conflicts need.
    """
    parsed = cut_lineage(row_rules(lines, options))
    verdicts = cut_lineage(key_conflicts(parsed))
    judged = (
        parsed.join(verdicts, ["file_no", "source_line"], "left")
        .withColumns({
            # The packet hash is shown for valid lines and for conflicts found after the key rule.
            "physical_packet_sha256": F.when(
                F.col("status").isNull() & ~F.coalesce("by_key", F.lit(False)),
                packet_sha256(F.col("dev_eui"), F.col("device_id"), F.col("received_at"),
                              F.col("frame_counter"))),
            "status": F.coalesce("status", "verdict", F.lit("valid")),
            "reason": F.coalesce("reason", "verdict_reason"),
        }).drop("verdict", "verdict_reason", "by_key"))
    accepted = judged.where("status = 'valid'").withColumnRenamed("physical_packet_sha256", "packet")

    problems = [count_check(parsed.where("part = 0"), options.expected_count)]
    usable = matches = None
    entries = judged.withColumn("live_message_key", F.lit(None).cast("string"))
    if baseline is not None:
        usable, rejected = validate_baseline(baseline, options)
        matches = cut_lineage(baseline_matches(accepted, usable))
        differing = matches.where("NOT equal").select(*_baseline_record(
            LIVE_VALUE_CONFLICT, _place("source_file", "source_line")))
        problems += [rejected, baseline_key_conflicts(accepted, usable), differing]
        overlaps = matches.where("equal").select("file_no", "source_line", "live_message_key")
        entries = judged.join(overlaps, ["file_no", "source_line"], "left").withColumns({
            "reason": F.when(F.col("live_message_key").isNotNull(), LIVE_OVERLAP).otherwise(F.col("reason")),
            "status": F.when(F.col("live_message_key").isNotNull(), "live_overlap").otherwise(F.col("status")),
        })
    extra = cut_lineage(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), problems))
    columns = ["source_file", "source_line", "status", "reason", "duplicate_of", "message_key",
               "live_message_key", "physical_packet_sha256", "observed_at", *READING_FIELDS]
    records = entries.select(*columns).unionByName(extra, allowMissingColumns=True)
    return Audit(options, records, entries, accepted, extra, baseline, usable, matches, source_files)
