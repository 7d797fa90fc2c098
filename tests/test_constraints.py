import pytest

from emberline.operators.constraints import ONE_KEY, ONE_OPEN_SESSION, KNOWN_READING, ConstraintError, violations, write_checked
from emberline.sources.sinks import path_exists

READINGS = "message_key string, device_id string, observed_at_ms long"
SESSIONS = "device_id string, started_at_ms long, ended_at_ms long, last_hot_at_ms long"
SOUND = [("a", "d", 1), ("b", "d", 2), ("c", "d", 3), ("z", "e", 1)]


@pytest.mark.parametrize(("readings", "sessions", "expected"), [
    (SOUND, [("d", 1, 2, 2), ("d", 3, None, 3), ("e", 1, None, 1)], set()),
    ([*SOUND, ("a", "e", 9)], [], {(ONE_KEY, "a", 2)}),
    (SOUND, [("d", 1, None, 2), ("d", 2, None, 3)], {(ONE_OPEN_SESSION, "d", 2)}),
    (SOUND, [("d", 1, 5, 5), ("e", 2, None, 2)], {(KNOWN_READING, "d@1", 1), (KNOWN_READING, "e@2", 1)}),
    ([], [], set()),
])
def test_violations_are_found_and_nothing_is_written(spark, tmp_path, readings, sessions, expected):
    tables = spark.createDataFrame(readings, READINGS), spark.createDataFrame(sessions, SESSIONS)
    assert {tuple(r) for r in violations(*tables).collect()} == expected
    path = str(tmp_path / "tables")
    if expected:
        with pytest.raises(ConstraintError, match=next(iter(expected))[0]):
            write_checked(*tables, path)
        assert not path_exists(spark, f"{path}/readings")
    else:
        assert set(write_checked(*tables, path).values()) == {0}
        assert spark.read.parquet(f"{path}/readings").count() == len(readings)
