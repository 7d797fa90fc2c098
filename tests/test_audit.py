import copy
import hashlib
import json
import random
import tracemalloc
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from messages import EUI, uplink

from emberline.operators import audit as A
from emberline.operators.claims import turned_away
from emberline.plans.queries import QUERIES
from emberline.sources.baseline import RowScanner, baseline_document, baseline_table
from emberline.sources.pages import file_hashes, page_lines, running_hashes, source_file_summary
from emberline.sources.sinks import publish_audit, published, published_version

AFTER, BEFORE = (round(datetime(2031, month, 1, tzinfo=timezone.utc).timestamp() * 1000) for month in (3, 4))
# A line of the archive: the first channel is the heater.
LINE = {"at": "2031-03-05T01:00:00.000Z", "first": 142.5, "second": 33.25, "counter": 18}


def message(**changes):
    return uplink(**(LINE | changes))


def live_row(archived, **changes):
    link = archived["uplink_message"]
    return {"message_key": "gs:uplink:live", "application_id": "field", "device_id": "kiln-3",
            "dev_eui": EUI, "received_at": archived["received_at"], "frame_counter": link["f_cnt"],
            "temp_channel_1_c": link["decoded_payload"]["Temp_Channel1"],
            "temp_channel_2_c": link["decoded_payload"]["Temp_Channel2"], **changes}


def options(count, **changes):
    return A.AuditOptions(AFTER, BEFORE, count, "field", EUI, **changes)


@pytest.fixture
def run(spark, tmp_path):
    def audit(messages, count=None, baseline=None, wrap=lambda m: {"result": m}, **changes):
        lines = [m if isinstance(m, str) else json.dumps(wrap(m)) for m in messages]
        (tmp_path / "page-001.ndjson").write_text("\n\n".join(lines) + "\n")
        rows = None
        if baseline is not None:
            (tmp_path / "live.json").write_text(json.dumps(baseline))
            rows = baseline_document(spark, str(tmp_path / "live.json"))
        return A.audit_pages(page_lines(spark, str(tmp_path)),
                             options(len(messages) if count is None else count, **changes), rows)
    return audit


def outcomes(audit):
    rows = audit.records.orderBy("source_file", "source_line", "reason").collect()
    return [(r.status, r.reason) for r in rows]


def replayed(audit):
    return [json.loads(r.envelope) for r in audit.replay().orderBy(*audit.replay_order()).collect()]


def test_wrapper(run):
    accepted = run([message()])
    assert accepted.can_replay()
    assert replayed(accepted) == [message()]
    rejected = run([message()], wrap=lambda m: {"data": m})
    assert outcomes(rejected) == [("error", A.NOT_WRAPPED)]
    assert replayed(rejected) == []


@pytest.mark.parametrize(("second", "expected"), [
    (message(first=200), ("error", A.KEY_CONFLICT)),
    (message(), ("duplicate", A.KEY_DUPLICATE)),
    (message(key="as:up:two"), ("error", A.PACKET_CONFLICT)),
    (message(key="as:up:two", counter=2), ("error", A.TIME_CONFLICT)),
])
def test_conflicts(run, second, expected):
    audit = run([message(), second])
    assert outcomes(audit) == [("valid", None), expected]
    record = audit.records.where("status <> 'valid'").first()
    assert tuple(record.duplicate_of) == ("page-001.ndjson", 1)
    assert (record.physical_packet_sha256 is None) == (expected[1] in (A.KEY_CONFLICT, A.KEY_DUPLICATE))
    assert len(replayed(audit)) == (1 if expected[0] == "duplicate" else 0)


def test_replay_is_oldest_first(run):
    times = ["2031-03-05T01:10:00Z", "2031-03-05T01:00:00Z", "2031-03-05T01:05:00Z"]
    audit = run([message(at=t, key=f"gs:uplink:{n}", counter=n) for n, t in enumerate(times)])
    assert [m["received_at"] for m in replayed(audit)] == sorted(times)
    summary = audit.summary().first()
    assert (summary.first_observed_at, summary.last_observed_at) == (times[1], times[0])
    assert (summary.storage_events, summary.valid, summary.replay_envelopes) == (3, 3, 3)


def test_live_overlap(run):
    archived = message()
    del archived["correlation_ids"]
    audit = run([archived], baseline=[{"results": [live_row(archived)]}])
    assert outcomes(audit) == [("live_overlap", A.LIVE_OVERLAP)]
    assert audit.records.first().live_message_key == "gs:uplink:live"
    summary = audit.summary().first()
    assert audit.can_replay()
    assert (summary.live_overlaps, summary.matched_archive_rows, summary.unmatched_rows) == (1, 1, 0)
    assert replayed(audit) == []


@pytest.mark.parametrize(("changes", "reason"), [
    ({"temp_channel_1_c": 999}, A.LIVE_VALUE_CONFLICT),
    ({"message_key": "gs:uplink:m-17", "received_at": "2031-03-05T02:00:00.000Z"}, A.LIVE_KEY_CONFLICT),
    ({"message_key": ""}, A.ROW_INCOMPLETE),
    ({"frame_counter": 1.5}, A.ROW_INCOMPLETE),
    ({"temp_channel_1_c": None, "temp_channel_2_c": None}, A.ROW_INCOMPLETE),
    ({"temp_channel_1_c": "hot"}, A.ROW_INCOMPLETE),
])
def test_live_errors(run, changes, reason):
    audit = run([message()], baseline=[live_row(message(), **changes)])
    assert outcomes(audit) == [("error", reason), ("valid", None)]
    assert not audit.can_replay()


def test_live_rows_that_repeat(run):
    row = live_row(message(), received_at="2031-03-05T03:00:00Z")
    audit = run([message()], baseline=[
        row, {**row, "frame_counter": 9}, {**row, "message_key": "gs:uplink:other"}, "text",
        {**row, "message_key": "gs:uplink:3", "frame_counter": 3}])
    assert outcomes(audit) == [("error", A.ROW_KEY_REPEATED), ("error", A.ROW_PACKET_REPEATED),
                               ("error", A.ROW_NOT_OBJECT), ("valid", None)]
    summary = audit.summary().first()
    assert (summary.baseline_rows, summary.unmatched_rows) == (5, 2)


def test_counter_reuse_is_reported_only(run):
    audit = run([message(at="2031-03-05T01:00:00Z", key="gs:uplink:1", counter=7),
                 message(at="2031-03-06T01:00:00Z", key="gs:uplink:2", counter=7)])
    assert len(replayed(audit)) == 2
    assert audit.summary().first().frame_counter_reuse_groups == 1


def test_row_rules(run):
    def changed(path, value):
        m = copy.deepcopy(message())
        target = m
        for key in path[:-1]:
            target = target[key]
        target[path[-1]] = value
        return m

    decoded = ("uplink_message", "decoded_payload")
    cases = [
        ("{", ["Line is not valid JSON"]),
        (changed(("end_device_ids", "application_ids", "application_id"), "x"), [A.WRONG_APPLICATION]),
        (changed(("end_device_ids", "device_id"), ""), [A.NO_DEVICE]),
        (changed(("end_device_ids", "dev_eui"), "00"), [A.WRONG_EUI]),
        (changed(("received_at",), "soon"), [A.BAD_TIME]),
        (message(at="2031-03-01T00:00:00Z"), [A.OUT_OF_BOUNDS]),
        (message(at="2031-04-01T00:00:00Z"), [A.OUT_OF_BOUNDS]),
        (changed(decoded, {"Temp_Channel1": None, "Temp_Channel2": "x"}),
         ["Temp_Channel1" + A.NOT_FINITE, "Temp_Channel2" + A.NOT_FINITE]),
        (changed(decoded, {"BatV": 3}), ["Uplink contained no temperature readings"]),
        (changed(decoded, None), ["Uplink had no decoded payload"]),
        (message(second=150.5), [A.IMPLAUSIBLE]),
        (message(first=601), [A.IMPLAUSIBLE]),
        (message(first=600, second=-40), [None]),
    ]
    audit = run([m for m, _ in cases])
    got = {}
    for r in audit.records.orderBy("source_line", "reason").collect():
        got.setdefault(r.source_line, []).append(r.reason)
    assert [got[2 * n + 1] for n in range(len(cases))] == [reasons for _, reasons in cases]
    assert audit.summary().first().storage_events == len(cases)


def test_counts(run):
    assert outcomes(run([message()], count=2))[0] == (
        "error", "Storage event count 1 does not match expected count 2")
    assert outcomes(run([], count=0)) == [("error", A.NO_EVENTS)]


@pytest.mark.parametrize("changes", [
    {"after_ms": BEFORE}, {"expected_count": -1}, {"expected_count": 1.5}, {"air_range_c": (5, 5)}])
def test_options(changes):
    with pytest.raises(ValueError):
        A.AuditOptions(**{"after_ms": AFTER, "before_ms": BEFORE, "expected_count": 1,
                          "application_id": "x", **changes})


def test_published_versions(run, spark, tmp_path):
    """Readers see one whole version: a clean one has a replay set, an unclean one withdraws it."""
    folder = str(tmp_path / "out")
    assert published_version(spark, folder) is None
    assert publish_audit(run([message()]), folder)
    first = published_version(spark, folder)
    manifest = published(spark, folder, "manifest").first()
    assert (manifest.replay_envelopes, manifest.errors, manifest.schema_version) == (1, 0, 1)
    assert manifest.validation.expected_storage_events == 1
    assert manifest.validation.after_exclusive < manifest.validation.before_exclusive
    assert manifest.validation.channel_mapping.asDict() == {"sauna": "Temp_Channel2", "stovepipe": "Temp_Channel1"}
    assert [json.loads(r.value) for r in published(spark, folder, "replay").collect()] == [message()]
    assert not publish_audit(run([message()], wrap=lambda m: {"data": m}), folder)
    assert published_version(spark, folder) != first
    assert published(spark, folder, "replay") is None
    assert published(spark, folder, "records").first().reason == A.NOT_WRAPPED
    assert published(spark, folder, "manifest").first().errors == 1


def test_an_interrupted_publication_changes_nothing(run, spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    publish_audit(run([message()]), folder)
    before = published_version(spark, folder)
    monkeypatch.setattr("emberline.sources.sinks._point_to", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        publish_audit(run([]), folder)
    assert published_version(spark, folder) == before
    assert published(spark, folder, "manifest").first().storage_events == 1


@pytest.mark.parametrize("content", [
    b"", b"\n", b"a", b"a\n", b"a\r\nb\rc\n\n", b"\xef\xbb\xbfa\nb", b"\xef\xbb\xbfa\n", b"\xef\xbb\xbf", b"\x00\xff\xfe\n\x80",
    b"x" * 5_000 + b"\n" + b"y" * 700])
def test_hash_of_any_bytes(spark, tmp_path, content):
    (tmp_path / "one.ndjson").write_bytes(content)
    (tmp_path / "two.ndjson").write_bytes(b"other\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = {r.file: r.sha256 for r in file_hashes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"one.ndjson": hashlib.sha256(content).hexdigest(), "two.ndjson": hashlib.sha256(b"other\n").hexdigest()}


def test_hashing_holds_a_chunk_at_a_time():
    """A file of a gigabyte passes through in a few megabytes."""
    chunk = b"z" * ((1 << 20) - 1) + b"\n"
    count = 1 << 10

    def batches():
        for n in range(count):
            yield pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([count << 20]), pa.array([n]), pa.array([chunk], pa.binary())],
                                             names=["path", "file_size", "at", "bytes"])

    expected = hashlib.sha256()
    for _ in range(count):
        expected.update(chunk)
    tracemalloc.start()
    (batch,) = running_hashes(batches())
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert batch.column(1)[0].as_py() == expected.hexdigest()
    assert peak < 8 << 20


def test_line_numbers_across_blocks(spark, tmp_path):
    texts = {f"page-{n}.ndjson": "".join(
        f"{n}:{i}" + ("\r\n" if i % 3 else "\n\n") for i in range(400 * n)) for n in (1, 2, 3)}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = page_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [(name, n + 1, line) for name, content in texts.items()
                for n, line in enumerate(content.replace("\r\n", "\n").split("\n")[:-1])]
    assert sorted((r.file, r.line_no, r.line) for r in got) == sorted(expected)
    ranks = {r.file: r.file_no for r in got}
    assert sorted(ranks, key=ranks.get) == sorted(texts)
    for r in source_file_summary(spark, str(tmp_path)).collect():
        lines = texts[r.file].replace("\r\n", "\n").split("\n")[:-1]
        assert r.sha256 == hashlib.sha256(texts[r.file].encode()).hexdigest()
        assert (r.json_lines, r.blank_lines) == (len([x for x in lines if x]), len([x for x in lines if not x]))


def test_claims_match_a_sequential_scan(spark):
    rng = random.Random(7)
    rows = [(n, f"m{rng.randint(0, 60)}", f"t{rng.randint(0, 60)}") for n in range(300)]
    held_a, held_b, expected = {}, {}, {}
    for n, a, b in rows:
        if a in held_a or b in held_b:
            expected[n] = (held_a.get(a), held_b.get(b))
        else:
            held_a[a] = held_b[b] = n
    away = turned_away(spark.createDataFrame(rows, "n long, a string, b string"), "a", "b", ("n",))
    got = {r.n: (r.holder_a and r.holder_a.n, r.holder_b and r.holder_b.n) for r in away.collect()}
    assert got == expected


def test_baseline_shapes(spark, tmp_path):
    def rows(document):
        (tmp_path / "b.json").write_text(json.dumps(document))
        return baseline_document(spark, str(tmp_path / "b.json")).count()
    assert rows([{"message_key": 1}, 5]) == 2
    assert rows({"results": [{}, {}, {}]}) == 3
    assert rows([{"results": [{}]}, {"results": [{}, {}]}]) == 3
    assert rows([{"results": [{}]}, {}]) == 2
    assert rows([]) == 0
    with pytest.raises(Exception, match="Live baseline must be"):
        rows({"rows": []})


def scanned(document, size):
    """The rows that the scanner finds in a text that comes in chunks, None for a wrong shape."""
    scanner, found = RowScanner(), {"entry": [], "inner": []}
    # As from the reader: every piece gets an end, the last one too.
    text = document if document.endswith("}") else document + "}"
    for at in range(0, len(text), size):
        for kind, number, item in scanner.feed(text[at:at + size]):
            found[kind].append(item)
            assert number == len(found[kind])
    shape = scanner.shape()
    return shape and [json.loads(x) for x in found[shape]]


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_scanning_equals_parsing(size):
    rng = random.Random(size)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return rng.choice([None, True, 1.5, -3, "", "a,b", 'q"}]', "back\\", "results", "{[:", "é\n"])
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["results", "a", "b}"]): value(depth - 1) for _ in range(rng.randrange(3))}

    def rows(document):
        entries = document if isinstance(document, list) else [document]
        if all(isinstance(e, dict) and isinstance(e.get("results"), list) for e in entries):
            return [r for e in entries for r in e["results"]]
        return entries if isinstance(document, list) else None

    for _ in range(400):
        document = rng.choice([
            [value(3) for _ in range(rng.randrange(4))],
            {"meta": value(2), "results": [value(2) for _ in range(rng.randrange(4))], "ok": value(1)},
            [{"results": [value(2) for _ in range(rng.randrange(3))], "x": value(2)} for _ in range(rng.randrange(3))],
            {"a": value(2)}])
        text = json.dumps(document, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        expected = rows(document)
        got = scanned(text, size)
        if isinstance(document, list) and expected is document:
            # Entries that have results lose what these hold when they are rows themselves.
            assert len(got) == len(document)
            assert all(g == d for g, d in zip(got, document) if not (isinstance(d, dict) and isinstance(d.get("results"), list)))
        else:
            assert got == expected
    for bad in ("", "5", "[1, 2", '{"results": [1}', "[1] x", '{"rows": []}'):
        assert scanned(bad, size) is None


def test_scanning_holds_a_row_at_a_time():
    """A document of some hundred megabytes, on one line, passes through in a few."""
    row = json.dumps({"message_key": "k", "text": "x" * 900}) + ", "
    scanner, count = RowScanner(), 0
    tracemalloc.start()
    list(scanner.feed('{"results": ['))
    for _ in range(400):
        count += sum(1 for _ in scanner.feed(row * 300))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert count == 120_000
    assert peak < 8 << 20


def test_baseline_from_a_table(spark):
    rows = [("k", "field", "kiln-3", EUI, "2031-03-05T01:00:00Z", 1, 1.0, None)]
    table = spark.createDataFrame(rows, "message_key string, application_id string, device_id string, "
                                  "dev_eui string, received_at string, frame_counter long, "
                                  "temp_channel_1_c double, temp_channel_2_c double")
    usable, problems = A.validate_baseline(
        baseline_table(table.selectExpr("*", "1 AS n"), "n"), options(1))
    assert (usable.count(), problems.count()) == (1, 0)


def test_published_audit_of_an_archive_with_errors_has_no_replay_lines(spark, tmp_path):
    """Two messages of a device at one time: there is no replay set, and the manifest says so."""
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id DIV 2) AS ts, 7L AS user_id,
        'view' AS event_type, 20.0D AS value, '{"k": 1}' AS props FROM range(1, 7)""").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    row = QUERIES["published_audit"](spark, str(tmp_path)).first()
    assert (row.storage_events, row.errors, row.replay_envelopes, row.replay_lines, row.first_observed_at) == (6, 2, 0, 0, None)


def test_a_published_audit_keeps_compressed_lines_and_no_stored_steps(spark, tmp_path, monkeypatch):
    """What stays of publishing is the versions: lines compressed, intermediate results gone."""
    folder = tmp_path / "shared"

    def place(spark, label):
        return f"{folder}/{label}-{len(list(folder.glob('*')))}"

    monkeypatch.setattr("emberline.session.shared_folder", place)
    monkeypatch.setattr("emberline.plans.queries.shared_folder", place)
    rows = [(n, f"2024-01-{2 + n // 24:02d} {n % 24:02d}:00:00", 5, "view", 20.0 + n, '{"k": 7}') for n in range(200)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    row = QUERIES["published_audit"](spark, str(tmp_path)).first()
    assert row.errors == 0 and row.replay_lines == row.replay_envelopes > 0
    assert not list(folder.glob("step-*"))
    files = [f for part in ("records", "replay") for f in folder.glob(f"published-*/versions/*/{part}/part-*")]
    assert files and all(f.name.endswith(".gz") for f in files)
