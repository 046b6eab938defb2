"""File states in a stream's state store."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import jobs, states

FILES = "file_id string, file_status string, registration_note string, extraction_status string, extracted_text string, extraction_error string, extracted_at timestamp"


def when(hour, minute=0):
    return dt.datetime(2024, 2, 1, hour, minute)


@pytest.fixture
def stream(spark, tmp_path):
    rows = [
        ("new", "stored", None, "none", None, None, None),
        ("lost", "stored", None, "none", None, None, None),
        ("open", "registration_done", "n", "pending", None, None, None),
        ("done", "registration_done", "n", "done", "old text", None, when(1)),
        ("bad", "registration_done", "n", "failed", None, "why", when(1)),
        ("away", "pending_upload", None, "none", None, None, None),
    ]

    def workers(work):
        found = work.filter("file_id <> 'lost'")
        kind = F.when(F.col("file_id") == "bad", "quarantined").otherwise("ok")
        return found.select("file_id", kind.alias("kind"), F.concat(F.lit("text of "), "file_id").alias("text"), F.lit("virus").alias("reason"), F.lit(when(2, 35)).alias("at"))

    made = states.FileStream(spark, str(tmp_path / "s"), workers)
    made.create(spark.createDataFrame(rows, FILES))
    return made


def jobs_of(spark, rows):
    return spark.createDataFrame([(f, "job", n, a) for f, n, a in rows], "file_id string, kind string, name string, at timestamp")


def told(stream):
    return {r.file_id: (r.file_status, r.extraction_status, r.extracted_text, r.extraction_error) for r in stream.current().collect()}


def test_life_of_files_over_restarts(spark, stream):
    stream.publish(jobs_of(spark, [("new", jobs.REGISTER, when(2)), ("new", jobs.REGISTER, when(2)), ("lost", jobs.REGISTER, when(2)), ("away", jobs.REGISTER, when(2)), ("nowhere", jobs.EXTRACT, when(2))]))
    stream.run()
    first = told(stream)
    assert first["new"] == ("registration_done", "done", "text of new", None)
    assert first["lost"] == ("registration_done", "processing", None, None)  # nothing came back yet
    assert first["away"] == ("pending_upload", "none", None, None) and "nowhere" not in first
    assert {r.registration_note for r in stream.current().filter("file_id = 'new'").collect()} == {"registered_at=2024-02-01T02:00:00.000Z"}

    # Another run goes on from the store. A done file isn't extracted again, another kind of job changes nothing, a second job on one in processing neither.
    asked = [("open", jobs.EXTRACT, when(2, 30)), ("done", jobs.EXTRACT, when(2, 30)), ("bad", jobs.EXTRACT, when(2, 30)), ("lost", jobs.EXTRACT, when(2, 30)), ("done", "tender.parse", when(2, 30))]
    stream.publish(jobs_of(spark, asked))
    stream.run()
    second = told(stream)
    assert second["open"] == ("registration_done", "done", "text of open", None) and second["done"] == ("registration_done", "done", "old text", None)
    assert second["bad"] == ("registration_done", "quarantined", None, "virus") and second["lost"][1] == "processing"

    # When the watermark passes the deadline, the file that nobody reported fails, and only that one.
    stream.publish(jobs_of(spark, [("done", "tender.parse", when(4))]))
    stream.run()
    third = told(stream)
    assert third.pop("lost") == ("registration_done", "failed", None, "timed out")
    second.pop("lost")
    assert third == second
    assert [r.extracted_at for r in stream.current().filter("file_id = 'lost'").collect()] == [when(3)]

    # Asked for again: cleared, and extracted by a later job; an outcome that comes too late for a failed file changes nothing.
    again = spark.createDataFrame([("done", "again", when(4, 1)), ("away", "again", when(4, 1))], "file_id string, kind string, at timestamp")
    late = spark.createDataFrame([("lost", "outcome", "ok", "too late", when(4, 1))], "file_id string, kind string, outcome string, text string, at timestamp")
    stream.publish(again)
    stream.publish(late)
    stream.run()
    fourth = told(stream)
    assert fourth["done"] == ("registration_done", "pending", None, None) and fourth["away"] == second["away"]
    assert fourth["lost"] == ("registration_done", "failed", None, "timed out")


def test_session_setting_comes_back(spark, stream):
    before = spark.conf.get(states._PROVIDER, None)
    stream.publish(jobs_of(spark, [("open", "tender.parse", when(2))]))
    stream.run()
    assert spark.conf.get(states._PROVIDER, None) == before and told(stream)["open"][1] == "pending"


class Store:
    """A group's state and timers, and how often the state was asked for or set."""

    def __init__(self, held):
        self.held, self.asked, self.set, self.timers = held, 0, 0, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.asked += 1
        return None if self.held is None else (self.held,)

    def update(self, value):
        self.set, self.held = self.set + 1, value[0]

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now

    def getExpiryTimeInMs(self):  # noqa: N802
        return min(self.timers)


def test_a_group_of_files_asks_the_store_once():
    """A store asked several times a file took 44 s for 15,000 files."""
    n = 3000
    status = ["processing"] * 3 + ["pending"] * (n - 3)
    table = pa.table({"file_group": [0] * n, "file_id": [f"f{i}" for i in range(n)], "file_status": ["registration_done"] * n, "extraction_status": status, "version": [0] * n})
    for c in ("registration_note", "extraction_error", "extracted_at"):
        table = table.append_column(c, pa.array([None] * n, pa.string() if c != "extracted_at" else pa.int64()))
    store = Store(states.first_states((pa.scalar(0),), table)["held"][0].as_py())
    store.now = 0
    life = states.FileStates(1000)
    life.init(store)

    def told(*rows):
        events = pd.DataFrame([dict.fromkeys(("kind", "name", "outcome", "text", "reason")) | r for r in rows])
        out = list(life.handleInputRows((0,), iter([events[:1], events[1:]]), store))
        return {r.file_id: r for r in out[0].itertuples()} if out else {}

    job = {"kind": "job", "name": jobs.EXTRACT, "at_ms": 5}
    ends = [{"file_id": "f0", "kind": "outcome", "outcome": "ok", "text": t, "at_ms": at} for t, at in (("old", 3), ("new", 4), ("older", 2))]
    failed = {"file_id": "f1", "kind": "outcome", "outcome": "error", "reason": "why", "at_ms": 3}
    first = told(*ends, failed, job | {"file_id": "f1"}, {"file_id": None, "kind": "job", "at_ms": 5}, *[job | {"file_id": f"f{i}"} for i in range(3, n)])
    assert len(first) == n - 1 and (store.asked, store.set) == (1, 1) and store.timers == {1005}
    assert (first["f0"].extraction_status, first["f0"].extracted_text, first["f0"].extracted_at, first["f0"].to_extract) == ("done", "new", 4, False)
    assert (first["f1"].extraction_status, first["f1"].to_extract) == ("processing", True)  # failed and asked for again at once: it is work
    assert told(job | {"file_id": "f1"}) == {} and store.set == 1  # in processing already
    told({"file_id": "f3", "kind": "outcome", "outcome": "skipped", "at_ms": 6}, job | {"file_id": "f0", "name": "again", "at_ms": 7}, job | {"file_id": "f0", "at_ms": 7})
    assert store.timers == {1005}
    store.now = 1006
    (late,) = life.handleExpiredTimer((0,), store, store)
    assert len(late) == n - 3 and set(late["extracted_at"]) == {1005} and set(late["extraction_error"]) == {"timed out"} and not set(late["file_id"]) & {"f0", "f2", "f3"}
    assert store.timers == {1007} and set(late["version"]) == {2}
    store.held = None
    assert told(job | {"file_id": "f9"}) == {}


def test_events_of_a_group_and_a_time_are_one_row(spark, stream):
    """Events went to the processor as rows, each handed over in Python on its own."""
    many = spark.range(20_000).selectExpr("if(id % 2 = 0, 'new', 'open') AS file_id", "'job' AS kind", f"if(id % 2 = 0, '{jobs.REGISTER}', '{jobs.EXTRACT}') AS name")
    stream.publish(many.withColumn("at", F.lit(when(2)).cast("timestamp")))
    stream.publish(jobs_of(spark, [("done", "tender.parse", None), (None, jobs.EXTRACT, when(2)), ("bad", jobs.EXTRACT, when(1, 55))]))
    kept = spark.read.parquet(f"{stream.folder}/events")
    assert kept.count() <= 3 + 3 and {r.at for r in kept.collect()} == {when(2), when(1, 55), None}
    stream.run()
    now = told(stream)
    assert now["new"][:3] == ("registration_done", "done", "text of new") and now["open"][1] == "done" and now["bad"][1] == "quarantined"


def test_long_texts_are_packed_in_bounded_values(spark, stream):
    long = spark.range(40).select(F.lit("open").alias("file_id"), F.lit("outcome").alias("kind"), F.lit("ok").alias("outcome"), F.repeat(F.lit("x"), 200_000).alias("text"), F.lit(when(2)).cast("timestamp").alias("at"))
    table = pa.table({c: long.withColumn("file_group", F.lit(0)).withColumn("name", F.lit("")).withColumn("reason", F.lit("")).withColumn("at_ms", F.lit(0)).toArrow()[c] for c in ("file_group", "at", *states._EVENT_COLUMNS)})
    rows = [r for b in states.packs(iter(table.combine_chunks().to_batches())) for r in b.column("events").to_pylist()]
    frames = [pa.ipc.open_stream(r).read_pandas() for r in rows]
    assert len(frames) > 5 and max(f["text"].str.len().sum() for f in frames) <= 2 * states._PACK_BYTES and sum(map(len, frames)) == 40
