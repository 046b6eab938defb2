"""Event-time windows and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import windows

SCHEMA = "id int, user string, ts timestamp, v int"


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 3, day, hour, minute)


#: Three arrivals; lateness two hours.
PARTS = [
    [(1, "a", at(8), 1), (2, "a", at(8, 20), 2), (3, "b", at(10), 4), (4, "b", None, 8)],
    [(5, "a", at(8, 5), 16), (6, "a", at(7, 59), 32), (7, "b", at(10, 10), 64), (8, None, at(14), 128)],
    [(9, "a", at(11, 59), 256), (10, "a", at(12), 512), (11, "b", at(14, 30), 1024), (11, "b", at(14, 30), 1024), (12, "a", at(0, 0, 2), 2048)],
]


@pytest.fixture(scope="module")
def streams(spark, tmp_path_factory):
    schema = spark.createDataFrame([], SCHEMA).schema
    made = windows.EventTime(spark, str(tmp_path_factory.mktemp("w")), schema, "ts", "2 hours")
    for part in PARTS:
        made.arrive(spark.createDataFrame(part, SCHEMA))
        made.part_late_rows().awaitTermination()
    return made


def test_late_rows_are_told_apart(streams):
    # The second part may lag to 08:00, which 08:05 meets and 07:59 doesn't; the third to 12:00.
    assert sorted((r.id, r.batch) for r in streams.late_rows().collect()) == [(6, 1), (9, 2)]
    kept = sorted(r.id for r in streams.rows_in_time().collect())
    assert kept == sorted(r[0] for part in PARTS for r in part if r[0] not in (6, 9))


def test_a_batch_again_changes_nothing(spark, streams):
    before = sorted(map(str, streams.late_rows().collect()))
    streams._part(spark.createDataFrame(PARTS[2], SCHEMA), 2)
    assert sorted(map(str, streams.late_rows().collect())) == before


def brute(rows, length, slide):
    """(user, start, end) -> [ids] over all windows that the watermark has passed."""
    mark, out = max(r[2] for r in rows if r[2]) - dt.timedelta(hours=2), {}
    for i, user, ts, _ in rows:
        if ts is not None:
            start = dt.datetime(1970, 1, 1) + (ts - dt.datetime(1970, 1, 1)) // slide * slide
            while start + length > ts:
                if start + length <= mark:
                    out.setdefault((user, start, start + length), []).append(i)
                start -= slide
    return out


@pytest.mark.parametrize(("kind", "length", "slide"), [("tumbling", 60, 60), ("sliding", 120, 30)])
def test_windows_against_brute_force(streams, kind, length, slide):
    window = windows.window_of(kind, "ts", f"{length} minutes", f"{slide} minutes")
    streams.count_windows(kind, window, ["user"], [F.sort_array(F.collect_list("id")).alias("ids")]).awaitTermination()
    found = {(r.user, r.window_start, r.window_end): r.ids for r in streams.windows(kind).collect()}
    rows = [r for part in PARTS for r in part if r[0] not in (6, 9)]
    assert found == brute(rows, dt.timedelta(minutes=length), dt.timedelta(minutes=slide)) and found


def test_sessions_end_after_a_silence(streams):
    streams.count_windows("session", windows.window_of("session", "ts", "30 minutes"), ["user"], [F.sum("v").alias("v")]).awaitTermination()
    found = sorted((r.user or "", r.window_start, r.window_end, r.v) for r in streams.windows("session").collect())
    assert found == [
        ("", at(14), at(14, 30), 128),
        ("a", at(8), at(8, 50), 1 + 2 + 16),
        ("a", at(12), at(12, 30), 512),
        ("b", at(10), at(10, 40), 4 + 64),
        ("b", at(14, 30), at(15), 2048),
    ]
