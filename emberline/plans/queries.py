"""One named query per operator, over the telemetry tables; each runs over the whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.functions import envelope as E
from emberline.functions import moments, numeric as N
from emberline.operators import (
    audit as A, constraints, current as C, dedupe as D, heat, history as H, months, normalize, rates as R,
    sessions as S,
)
from emberline.plans import telemetry as T
from emberline.session import passing_steps, prepare, shared_folder
from emberline.sources import messages as M, pages
from emberline.sources.baseline import baseline_document
from emberline.sources.sinks import export_readings, insert_if_absent, publish_audit, published
from emberline.streaming.devices import device_stream, sessions_of
from emberline.streaming import ingest as streams
from emberline.streaming.ingest import downsample_stream, latest_stream

CFG, AS_OF, ARRIVAL = T.CADENCE, T.AS_OF_MS, T.ARRIVAL
# History buckets follow a five-minute interval, gaps and rates the table's own cadence.
HISTORY = CFG.with_changes(expected_interval_s=300)
ALTERNATIVE = CFG.with_changes(start_c=60, end_c=40, end_hold_min=24 * 60, start_samples=3)
TARGET_F = 180.0
# Streams take in two parts of the table per micro-batch, and deal keys and loose rows into so many groups.
PARTS, LANES = 2, 64

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    prepared.__name__ = run.__name__
    prepared.__doc__ = run.__doc__
    QUERIES[run.__name__] = prepared
    return prepared


def six(column: str | Column) -> Column:
    """Six decimals of a regression rate: the two engines' formulas differ in the last bits."""
    return N.half_up(F.col(column) if isinstance(column, str) else column, 6)


# Readings and identity ------------------------------------------------------------------------

@query
def readings_view(spark, sf_dir):
    return T.readings(spark, sf_dir)


@query
def dedupe_first(spark, sf_dir):
    """Every reading arrives twice, the later time with another value."""
    rows = T.readings(spark, sf_dir).select("event_id", "message_key", "stovepipe_temp_c")
    twice = rows.withColumn("arrival", F.col("event_id") % 2).unionByName(rows.select(
        "event_id", "message_key", (F.col("stovepipe_temp_c") + 1).alias("stovepipe_temp_c"),
        ((F.col("event_id") + 1) % 2).alias("arrival")))
    return D.dedupe_first(twice, "message_key", ("arrival",))


@query
def new_rows_only(spark, sf_dir):
    """A stored table with every third reading meets a batch with all of them."""
    rows = T.readings(spark, sf_dir).select("event_id", "message_key", "stovepipe_temp_c")
    return D.new_rows_only(rows, rows.where("event_id % 3 = 0"))


@query
def insert_readings(spark, sf_dir):
    """Two overlapping writes through the readings sink, then the stored table."""
    rows = T.readings(spark, sf_dir)
    path = shared_folder(spark, "readings")
    insert_if_absent(rows.where("event_id % 3 <> 0"), path, ARRIVAL)
    again = rows.withColumn("stovepipe_temp_c", F.col("stovepipe_temp_c") + 1)
    insert_if_absent(again.unionByName(again), path, ARRIVAL)
    return spark.read.parquet(path).select(
        "event_id", "message_key", "stovepipe_temp_c", F.col("event_date").cast("string"))


@query
def monotone_latest(spark, sf_dir):
    """Held state from the even events meets the odd ones."""
    rows = T.readings(spark, sf_dir).select("device_id", "observed_at_ms", "message_key")
    held = D.latest_of(rows.where("substring(message_key, 4) % 2 = 0"))
    return D.monotone_latest(held, rows.where("substring(message_key, 4) % 2 = 1"))


@query
def frame_counter_reuse(spark, sf_dir):
    return D.frame_counter_reuse(T.readings(spark, sf_dir))


@query
def packet_identity(spark, sf_dir):
    r = T.readings(spark, sf_dir)
    return r.select("event_id", D.packet_sha256(
        F.col("dev_eui"), F.col("device_id"), F.col("received_at"), F.col("frame_counter")).alias("packet"))


@query
def repeated_signatures(spark, sf_dir):
    """Readings equal in all but their key: each is met twice, changed where the key is odd."""
    rows = T.readings(spark, sf_dir)
    changed = rows.withColumn("stovepipe_temp_c", F.col("stovepipe_temp_c") + F.col("event_id") % 2)
    signed = rows.select("event_id", D.reading_signature().alias("signature")).unionByName(
        changed.select("event_id", D.reading_signature().alias("signature")))
    return signed.groupBy("event_id", "signature").agg(F.count("*").alias("copies")).drop("signature")


# Rates and sessions ---------------------------------------------------------------------------

@query
def gap_segments(spark, sf_dir):
    rows = T.readings(spark, sf_dir).select("event_id", "device_id", "observed_at_ms")
    sliced = R.spread(rows, R.slice_length(R.detection_look_back(CFG), CFG), CFG.max_gap_ms)
    return sliced.transform(_slice_segments)


def _slice_segments(sliced: DataFrame) -> DataFrame:
    """Where a new segment begins, decided within slices that see one gap length back."""
    marked = R.gap_segments(sliced, CFG.max_gap_ms, (R.DEVICE, R.SLICE), (R.TIME, "event_id"))
    line = R.Window.partitionBy(R.DEVICE, R.SLICE).orderBy(R.TIME, "event_id")
    before = F.lag("segment").over(line)
    return marked.withColumn("_before", before).where(R.OWN).select(
        "event_id", "device_id",
        # The first row of a slice without an earlier row in reach begins a segment as well.
        F.coalesce(F.col("segment") > F.col("_before"), F.lit(True)).alias("begins"))


@query
def rolling_rate(spark, sf_dir):
    rows = T.readings(spark, sf_dir).select(
        "event_id", "device_id", "observed_at_ms", "sauna_temp_c", "stovepipe_temp_c")
    return R.with_rates(rows, CFG, ARRIVAL).select(
        "event_id", "device_id", "observed_at_ms",
        six("sauna_rate_c_per_min").alias("sauna_rate_c_per_min"),
        six("stovepipe_rate_c_per_min").alias("stovepipe_rate_c_per_min"))


def _sessions(spark: SparkSession, sf_dir: str, cfg=CFG) -> DataFrame:
    return S.detect_sessions(T.readings(spark, sf_dir), cfg, ARRIVAL)


@query
def sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select(
        "device_id", "started_at_ms", "ended_at_ms", "last_hot_at_ms", "complete")


@query
def session_metrics(spark, sf_dir):
    return _sessions(spark, sf_dir).select(
        "device_id", "started_at_ms", "peak_sauna_c", "peak_stovepipe_c",
        six("max_stovepipe_rate_c_per_min").alias("max_stovepipe_rate_c_per_min"), "sample_count")


@query
def sessions_rebuild_alt_thresholds(spark, sf_dir):
    return _sessions(spark, sf_dir, ALTERNATIVE).select(
        "device_id", "started_at_ms", "ended_at_ms", "last_hot_at_ms", "peak_stovepipe_c",
        "sample_count", "complete")


@query
def open_sessions(spark, sf_dir):
    return S.open_sessions(_sessions(spark, sf_dir))


@query
def sessions_since(spark, sf_dir):
    since = months.look_back_start_ms(1, AS_OF, "America/New_York") + 12 * H.DAY_MS
    return S.sessions_since(_sessions(spark, sf_dir), since).select(
        "device_id", "started_at_ms", "ended_at_ms")


# History --------------------------------------------------------------------------------------

@query
def oldest_reading(spark, sf_dir):
    return H.oldest_reading_time(T.readings(spark, sf_dir))


def _bounded(spark: SparkSession, sf_dir: str, range_name: str) -> tuple[H.HistoryBounds, DataFrame]:
    """Bounds of a range and its readings with rates; the scan reads only that part of the table."""
    bounds = H.HistoryBounds.of(T.readings(spark, sf_dir), range_name, AS_OF, HISTORY)
    part = T.readings(spark, sf_dir, bounds.from_ms - CFG.window_ms, bounds.to_ms)
    return bounds, H.rates_within(part, bounds, CFG, ARRIVAL)


def _buckets(spark: SparkSession, sf_dir: str, range_name: str, by: tuple[str, ...] = ()) -> DataFrame:
    bounds, part = _bounded(spark, sf_dir, range_name)
    buckets = H.downsample(part, bounds, by)
    # Mean temperatures are equal to the last bit; mean rates are as near as the rates they are of.
    return buckets.select(*[six(c).alias(c) if "_rate_avg_" in c else c for c in buckets.columns])


@query
def history_24h(spark, sf_dir):
    return _buckets(spark, sf_dir, "24h", ("device_id",))


@query
def history_7d(spark, sf_dir):
    return _buckets(spark, sf_dir, "7d")


@query
def history_30d(spark, sf_dir):
    return _buckets(spark, sf_dir, "30d", ("device_id",))


@query
def history_all(spark, sf_dir):
    return _buckets(spark, sf_dir, "all")


def _points(spark: SparkSession, sf_dir: str, range_name: str, unit: str,
            by: tuple[str, ...] = ()) -> tuple[DataFrame, H.HistoryBounds]:
    bounds, part = _bounded(spark, sf_dir, range_name)
    return H.to_long_form(H.downsample(part, bounds, by), unit, by), bounds


@query
def history_long_form(spark, sf_dir):
    return _points(spark, sf_dir, "all", "f")[0].drop("point_ms")


@query
def history_segments(spark, sf_dir):
    points, bounds = _points(spark, sf_dir, "7d", "c", ("device_id",))
    return H.history_segments(points, bounds.max_gap_ms(HISTORY), ("device_id",)).drop("point_ms")


@query
def history_readouts(spark, sf_dir):
    points, _ = _points(spark, sf_dir, "7d", "f", ("device_id",))
    return H.history_readouts(points).select(
        "device_id", "ts", "series", six("rate_per_hour").alias("rate_per_hour"),
        "temperature_readout", "rate_readout")


# Requests as they come: range and unit names, known or not.
REQUESTS = (("1h", "C"), ("3h", "f"), ("12h", "c"), ("90d", "kelvin"), (None, None))


@query
def history_requests(spark, sf_dir):
    """Whole requests a day before the end of the table, with their bounds, buckets and units."""
    as_of = AS_OF - H.DAY_MS
    near = T.readings(spark, sf_dir, as_of - H.DAY_MS - CFG.window_ms, as_of + 1)
    rated = R.with_rates(near, CFG, ARRIVAL)
    answers = [H.history_request(rated, name, as_of, HISTORY, unit).described().withColumn("request", F.lit(n))
               for n, (name, unit) in enumerate(REQUESTS)]
    return reduce(DataFrame.unionByName, answers)


# Current state --------------------------------------------------------------------------------

def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.current_readings(T.readings(spark, sf_dir), CFG, ARRIVAL)


@query
def current_reading(spark, sf_dir):
    """The newest reading of all, whatever the device."""
    return D.latest_of(T.readings(spark, sf_dir), ()).select(
        "message_key", "observed_at_ms", "received_at", "sauna_temp_c", "stovepipe_temp_c")


@query
def current_fleet(spark, sf_dir):
    return _current(spark, sf_dir).select(
        "device_id", "message_key", "observed_at_ms", "received_at", "sauna_temp_c", "stovepipe_temp_c",
        six("sauna_rate_c_per_min").alias("sauna_rate_c_per_min"),
        six("stovepipe_rate_c_per_min").alias("stovepipe_rate_c_per_min"), "battery_v", "rssi_dbm", "snr_db")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of all devices; one in seven is also known under a number that never reported."""
    name = F.col("user_id").cast("string")
    names = F.array_compact(F.array(name, F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("silent-"), name))))
    devices = T.events(spark, sf_dir).select("user_id").distinct().select(F.explode(names).alias("device_id"))
    active = S.active_devices(T.readings(spark, sf_dir), CFG, ARRIVAL)
    return C.current_summary(_current(spark, sf_dir), active, AS_OF, CFG, devices)


@query
def current_summary(spark, sf_dir):
    probes = [F.col(f"current.{probe}.{value}").alias(f"{probe}_{value}")
              for probe in ("sauna", "stovepipe") for value in ("c", "f", "rate_c_per_min", "rate_f_per_min")]
    return _summary(spark, sf_dir).select(
        "device_id", "status", "session_active", F.col("current.observed_at").alias("observed_at"),
        F.col("current.age_seconds").alias("age_seconds"), *probes,
        F.col("current.battery_v").alias("battery_v"),
        F.col("current.signal.rssi_dbm").alias("rssi_dbm"), F.col("current.signal.snr_db").alias("snr_db"))


@query
def freshness(spark, sf_dir):
    """Devices by freshness a day before the end of the table, when later readings lie ahead."""
    as_of = AS_OF - 2 * H.DAY_MS
    newest = T.readings(spark, sf_dir).groupBy("device_id").agg(F.max("observed_at_ms").alias("t"))
    return newest.select("device_id", C.age_seconds(F.col("t"), as_of).alias("age_seconds"),
                         C.freshness(F.col("t"), as_of, CFG).alias("status"))


@query
def heat_status(spark, sf_dir):
    return heat.fleet_heat_status(_summary(spark, sf_dir), TARGET_F, AS_OF, CFG.time_zone)


@query
def heat_projection(spark, sf_dir):
    """The projection for every reading as if seen a minute later, with rates that span its rules."""
    rows = T.readings(spark, sf_dir)
    rate = N.half_up((F.col("event_id") % 41 - 12) / 60.0, 3)
    shown = heat.heat_status(
        N.temperature(F.col("stovepipe_temp_c"), "f"), rate, F.lit(AS_OF) - F.col("event_id") % 600_000,
        F.when(F.col("event_id") % 13 == 0, "stale").otherwise("live"),
        F.col("event_id") % 2 == 0, TARGET_F, AS_OF, "UTC")
    return rows.select("event_id", shown.alias("_s")).select("event_id", "_s.*")


@query
def display_snapshot(spark, sf_dir):
    return C.display_snapshot(_current(spark, sf_dir))


# Month report ---------------------------------------------------------------------------------

@query
def month_spine(spark, sf_dir):
    """The months up to the newest reading of the table."""
    newest = T.readings(spark, sf_dir).agg(F.max("observed_at_ms").alias("t")).first()["t"]
    return months.month_spine(spark, 36, newest, CFG.time_zone)


@query
def sessions_by_month(spark, sf_dir):
    return months.sessions_by_month(_sessions(spark, sf_dir), 12, AS_OF, CFG.time_zone)


# Messages -------------------------------------------------------------------------------------

def _parsed(spark: SparkSession, sf_dir: str, cfg=CFG) -> DataFrame:
    body = M.parsable(M.with_body(T.messages(spark, sf_dir))).drop("value")
    return normalize.normalize_uplinks(body, cfg)


@query
def unreadable_messages(spark, sf_dir):
    return M.unparsable(M.with_body(T.messages(spark, sf_dir))).select("event_id", "problem")


@query
def normalize_uplinks(spark, sf_dir):
    return normalize.readings_of(_parsed(spark, sf_dir), "event_id")


@query
def message_outcomes(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "outcome", "reason")


@query
def message_key(spark, sf_dir):
    return normalize.readings_of(_parsed(spark, sf_dir), "event_id").select("event_id", "message_key")


@query
def strongest_reception(spark, sf_dir):
    return normalize.readings_of(_parsed(spark, sf_dir), "event_id").select("event_id", "rssi_dbm", "snr_db")


@query
def swapped_channels(spark, sf_dir):
    cfg = CFG.with_changes(air_channel=2, heater_channel=1)
    return normalize.readings_of(_parsed(spark, sf_dir, cfg), "event_id").select(
        "event_id", "sauna_temp_c", "stovepipe_temp_c")


@query
def select_event_from_array(spark, sf_dir):
    """What is chosen from messages wrapped in arrays, told by the correlation id."""
    body = M.parsable(M.with_body(T.messages(spark, sf_dir)))
    chosen = E.opened(E.chosen_message(F.col("body")), "correlation_ids", "received_at")
    return body.select("event_id", E.text(chosen.received_at).alias("received_at"),
                       E.uplink_id(chosen.correlation_ids).alias("uplink_id"))


@query
def expect_source(spark, sf_dir):
    """Only device 7 is expected."""
    cfg = CFG.with_changes(application_id=T.APPLICATION, dev_eui=f"{7:016X}")
    return normalize.expect_source(_parsed(spark, sf_dir, cfg), cfg).groupBy("outcome", "reason").agg(
        F.count("*").alias("messages"))


@query
def json_numbers(spark, sf_dir):
    """Numbers in JSON in many spellings, one per event."""
    n, value = F.col("event_id"), F.col("value").cast("string")
    spelled = (
        F.when(n % 8 == 0, value)
        .when(n % 8 == 1, F.concat(F.lit('" '), value, F.lit(' "')))
        .when(n % 8 == 2, F.lit("true"))
        .when(n % 8 == 3, F.concat(F.lit('"'), value, F.lit('d"')))
        .when(n % 8 == 4, n.cast("string"))
        .when(n % 8 == 5, F.concat(F.lit('"0x'), F.hex(n), F.lit('"')))
        .when(n % 8 == 6, F.lit('"Infinity"'))
        .otherwise(F.concat(F.lit("["), value, F.lit("]"))))
    parsed = F.try_parse_json(spelled)
    return T.events(spark, sf_dir).select(
        "event_id", E.finite(parsed).alias("number"), E.integral(parsed).alias("whole"))


# Functions ------------------------------------------------------------------------------------

@query
def conversions(spark, sf_dir):
    value = F.col("value")
    return T.events(spark, sf_dir).select(
        "event_id", N.temperature(value, "f").alias("temp_f"), N.temperature(-value, "c").alias("minus_c"),
        N.rate(value / 7, "f").alias("rate_f"), N.half_up(-value, 0).alias("whole"),
        N.fixed(-value, 1).alias("tenths"), N.fixed(value, 0).alias("units"))


@query
def time_texts(spark, sf_dir):
    time = F.col("observed_at_ms")
    return T.readings(spark, sf_dir).select(
        "event_id", moments.iso_utc(time).alias("iso"), moments.epoch_ms(F.col("received_at")).alias("back"),
        moments.month_key(time, CFG.time_zone).alias("month"), moments.clock(time, CFG.time_zone).alias("clock"),
        moments.duration_label(F.col("event_id") % 600).alias("duration"))


# Archive audit --------------------------------------------------------------------------------

def _audit(spark: SparkSession, sf_dir: str, flawed: bool) -> A.Audit:
    lines = T.archive_lines(spark, sf_dir, flawed)
    case = F.col("event_id") % 40
    sent = T.events(spark, sf_dir).agg((F.count("*") + F.count_if(case <= (3 if flawed else 0))).alias("n")).first().n
    options = A.AuditOptions(
        after_ms=0, before_ms=AS_OF, expected_count=sent + (1 if flawed else 0),
        application_id=T.APPLICATION, air_range_c=(-40, 400))
    return A.audit_pages(lines, options, T.live_rows(spark, sf_dir, flawed))


@query
def audit_row_rules(spark, sf_dir):
    lines = T.archive_lines(spark, sf_dir, flawed=True)
    options = A.AuditOptions(0, AS_OF, 0, T.APPLICATION, air_range_c=(-40, 400))
    return A.row_rules(lines, options).select(
        "source_file", "source_line", "status", "reason", "message_key", "observed_at", "device_id",
        "dev_eui", "frame_counter", "sauna_temp_c", "stovepipe_temp_c")


@query
def audit_key_conflicts(spark, sf_dir):
    """Every line's final verdict, with the line it repeats."""
    return _audit(spark, sf_dir, flawed=True).records.where("source_line > 0").where(
        F.col("source_file") != A.LIVE_BASELINE).select(
        "source_file", "source_line", "status", "reason",
        F.col("duplicate_of.source_file").alias("of_file"), F.col("duplicate_of.source_line").alias("of_line"),
        "physical_packet_sha256")


@query
def baseline_validation(spark, sf_dir):
    options = A.AuditOptions(0, AS_OF, 0, T.APPLICATION)
    usable, problems = A.validate_baseline(T.live_rows(spark, sf_dir, flawed=True), options)
    good = usable.select(F.col("row_no").alias("source_line"), F.lit("usable").alias("verdict"),
                         F.lit(None).cast("bigint").alias("repeats"))
    return good.unionByName(problems.select(
        "source_line", F.col("reason").alias("verdict"),
        F.col("duplicate_of.source_line").alias("repeats")))


@query
def baseline_overlap(spark, sf_dir):
    """What the reconciliation with the live rows adds: overlaps and disagreements."""
    records = _audit(spark, sf_dir, flawed=True).records
    overlap = records.where("status = 'live_overlap'").select(
        "source_file", "source_line", "reason", "live_message_key")
    wrong = records.where(F.col("reason").isin(A.LIVE_KEY_CONFLICT, A.LIVE_VALUE_CONFLICT)).select(
        F.col("duplicate_of.source_file"), F.col("duplicate_of.source_line"), "reason",
        F.lit(None).cast("string").alias("live_message_key"))
    return overlap.unionByName(wrong)


@query
def replay_set(spark, sf_dir):
    audit = _audit(spark, sf_dir, flawed=False)
    envelope = E.opened(F.try_parse_json("envelope"), "received_at", "correlation_ids")
    return audit.replay().select(
        "observed_at_ms", "device_id", "message_key", E.text(envelope.received_at).alias("received_at"),
        E.uplink_id(envelope.correlation_ids).alias("uplink_id"))


@query
def audit_summary(spark, sf_dir):
    return _audit(spark, sf_dir, flawed=True).summary()


@query
def audit_summary_clean(spark, sf_dir):
    return _audit(spark, sf_dir, flawed=False).summary()


def _written_pages(spark: SparkSession, sf_dir: str) -> str:
    """The event properties as NDJSON pages in the shared folder, a blank line after every fifth."""
    folder = shared_folder(spark, "pages")
    line = F.concat(F.col("props"), F.when(F.col("event_id") % 5 == 0, "\n").otherwise(""))
    (T.events(spark, sf_dir)
     .select(F.floor(F.col("event_id") / T.PAGE_LINES).alias("page"), "event_id", line.alias("value"))
     .repartition("page").sortWithinPartitions("page", "event_id").drop("event_id")
     .write.partitionBy("page").text(folder))
    return folder


def _page_number(path: Column) -> Column:
    return F.regexp_extract(path, r"page=(\d+)", 1).cast("bigint")


@query
def page_lines(spark, sf_dir):
    lines = pages.page_lines(spark, _written_pages(spark, sf_dir), "*.txt")
    return lines.select(_page_number(F.col("path")).alias("page"), "line_no", "line")


@query
def source_file_summary(spark, sf_dir):
    files = pages.source_file_summary(spark, _written_pages(spark, sf_dir), "*.txt")
    return files.select(_page_number(F.col("path")).alias("page"), "sha256", "json_lines", "blank_lines")


@query
def published_audit(spark, sf_dir):
    """The manifest that is published: an unclean version, replaced by a clean one."""
    folder = shared_folder(spark, "published")
    for flawed in (True, False):
        with passing_steps(spark):
            publish_audit(_audit(spark, sf_dir, flawed), folder)
    replayed = published(spark, folder, "replay")
    if replayed is None:  # the clean form found errors too, such as two messages of a device at one time
        replayed = spark.createDataFrame([], "value string")
    replay = replayed.agg(F.count("*").alias("replay_lines"))
    manifest = published(spark, folder, "manifest").withColumn("_one", F.lit(1))
    checked = F.col("validation")
    return manifest.join(replay.withColumn("_one", F.lit(1)), "_one").select(
        "schema_version", "storage_events", "valid", "live_overlaps", "duplicates", "errors", "replay_envelopes", "replay_lines",
        "first_observed_at", checked.expected_application_id.alias("application"), checked.expected_dev_eui.alias("eui"),
        checked.after_exclusive.alias("after"), checked.before_exclusive.alias("before"),
        checked.expected_storage_events.alias("expected"), checked.sauna_range_c.maximum.alias("sauna_maximum"),
        checked.channel_mapping.sauna.alias("sauna_channel"))


@query
def live_baseline(spark, sf_dir):
    """The live rows written as a JSON document of result pages and read back."""
    folder = shared_folder(spark, "baseline")
    rows = T.live_rows(spark, sf_dir, flawed=True).select("row_no", F.to_json("row").alias("row"))
    pages_of_rows = rows.groupBy(F.floor(F.col("row_no") / 5_000).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("row_no", "row"))).alias("rows"))
    texts = pages_of_rows.select("page", F.concat(F.lit('{"results":['), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]}")).alias("text"))
    # A document is one object per page here; the page's number tells the rows of documents apart.
    texts.repartition("page").write.partitionBy("page").text(folder)
    read = baseline_document(spark, folder, "page")
    key = E.opened(F.col("row"), "message_key", "frame_counter")
    return read.select("page", "row_no", E.text(key.message_key).alias("message_key"), E.integral(key.frame_counter).alias("frame_counter"))


@query
def exported_readings(spark, sf_dir):
    """A snapshot in each format, read back."""
    rows = T.readings(spark, sf_dir).select("event_id", "message_key", "observed_at_ms", "sauna_temp_c", "stovepipe_temp_c")
    back = []
    for kind in ("parquet", "json", "csv"):
        folder = shared_folder(spark, kind)
        export_readings(rows, folder, kind)
        reader = spark.read.schema(rows.schema).option("header", "true")
        back.append(reader.format(kind).load(folder).withColumn("format", F.lit(kind)))
    return reduce(DataFrame.unionByName, back)


@query
def constraint_violations(spark, sf_dir):
    """Tables with planted faults: readings met twice, second open sessions, sessions nobody measured."""
    rows = T.readings(spark, sf_dir)
    twice = rows.unionByName(rows.where("event_id % 50 = 0"))
    first, last = F.min("observed_at_ms"), F.max("observed_at_ms")
    devices = rows.groupBy("device_id").agg(first.alias("first"), last.alias("last"))
    number, open_end = F.col("device_id").cast("bigint"), F.lit(None).cast("bigint")

    def session(start, end):
        return [F.col("device_id"), start.alias("started_at_ms"), end.alias("ended_at_ms"), F.coalesce(end, start).alias("last_hot_at_ms")]

    sound = devices.select(*session(F.col("first"), F.when(number % 10 != 0, F.col("last"))))
    second = devices.where(number % 10 == 0).select(*session(F.col("last"), open_end))
    unmeasured = devices.where(number % 15 == 0).select(*session(F.col("first") - 1, F.col("last")))
    return constraints.violations(twice, sound.unionByName(second).unionByName(unmeasured))


# Streams --------------------------------------------------------------------------------------

def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry table as a stream of files that arrive part by part, over several micro-batches."""
    folder = shared_folder(spark, "arriving")
    T.send_readings(spark, sf_dir, folder)
    schema = T.readings(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", PARTS * T.files_per_part(spark)).parquet(folder)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and read back what it wrote, batch by batch."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).outputMode(mode)
     .option("checkpointLocation", shared_folder(spark, "offsets"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


def _last_update(updates: DataFrame, key: str) -> DataFrame:
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


@query
def stream_ingest(spark, sf_dir):
    """Messages that arrive twice, over several micro-batches: each reading is stored once, as it first came."""
    source, stored = shared_folder(spark, "messages"), shared_folder(spark, "stored")
    T.send_messages(spark, sf_dir, source)
    (streams.ingest(M.json_message_stream(spark, source, PARTS * T.files_per_part(spark)), CFG, stored, shared_folder(spark, "offsets"), LANES)
     .trigger(availableNow=True).start().awaitTermination())
    return streams.stored_rows(spark, stored).select(
        "message_key", "observed_at_ms", "device_id", "frame_counter", "f_port", "sauna_temp_c", "stovepipe_temp_c")


def _pipeline(spark: SparkSession, sf_dir: str, late: bool) -> tuple[str, str]:
    """Run the whole pipeline over arriving messages; where it stored rows and late readings' rates."""
    source, stored, late_path = (shared_folder(spark, name) for name in ("messages", "stored", "late"))
    T.send_messages(spark, sf_dir, source, late)
    (streams.pipeline(M.json_message_stream(spark, source, PARTS * T.files_per_part(spark)), CFG, stored, late_path, shared_folder(spark, "offsets"), LANES)
     .trigger(availableNow=True).start().awaitTermination())
    return stored, late_path


def _rated(rows: DataFrame) -> DataFrame:
    return rows.select("message_key", "device_id", "observed_at_ms", "f_port", *[
        six(c).alias(c) for c in ("sauna_rate_c_per_min", "stovepipe_rate_c_per_min")])


@query
def stream_pipeline(spark, sf_dir):
    """Each message twice, from text to rates on insert; the repeat derives nothing."""
    stored, late_path = _pipeline(spark, sf_dir, late=False)
    return _rated(streams.derived_rows(spark, stored, late_path))


@query
def stream_pipeline_sessions(spark, sf_dir):
    """The sessions that the same run leaves."""
    stored, late_path = _pipeline(spark, sf_dir, late=False)
    return sessions_of(streams.derived_rows(spark, stored, late_path)).select(
        "device_id", "started_at_ms", "ended_at_ms", "last_hot_at_ms", "peak_sauna_c", "peak_stovepipe_c", "sample_count", "complete")


@query
def stream_late(spark, sf_dir):
    """Every tenth message comes after all others: rated by what is there, earlier ones are not revised."""
    stored, late_path = _pipeline(spark, sf_dir, late=True)
    return _rated(streams.derived_rows(spark, stored, late_path))


@query
def stream_rates(spark, sf_dir):
    return _run(device_stream(_stream(spark, sf_dir), CFG, "observed_at_ms"), "append").select(
        "message_key", six("sauna_rate_c_per_min").alias("sauna_rate_c_per_min"),
        six("stovepipe_rate_c_per_min").alias("stovepipe_rate_c_per_min"))


@query
def stream_sessions(spark, sf_dir):
    rows = _run(device_stream(_stream(spark, sf_dir), CFG, "observed_at_ms"), "append")
    return sessions_of(rows).withColumn(
        "max_stovepipe_rate_c_per_min", six("max_stovepipe_rate_c_per_min"))


@query
def stream_downsample(spark, sf_dir):
    updates = _run(downsample_stream(_stream(spark, sf_dir), H.HOUR_MS), "update")
    return _last_update(updates, "bucket_ms")


@query
def stream_bucket_rates(spark, sf_dir):
    """Hourly buckets of readings that arrive with their rates: also the average rates."""
    folder = shared_folder(spark, "rated")
    R.with_rates(T.readings(spark, sf_dir), CFG, ARRIVAL).write.parquet(folder)
    rated = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    last = _last_update(_run(downsample_stream(rated, H.HOUR_MS), "update"), "bucket_ms")
    return last.select("bucket_ms", "readings", "sauna_avg_c", *[
        six(f"{probe}_rate_avg_c_per_min").alias(f"{probe}_rate_avg_c_per_min") for probe in ("sauna", "stovepipe")])


@query
def stream_latest(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("device_id", "observed_at_ms", "message_key")
    return _last_update(_run(latest_stream(rows), "update"), "device_id")
