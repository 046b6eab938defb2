"""File states kept in the state store of a stream.

Events come as files in a folder: jobs by name, outcomes of extractions, and requests to extract again. Those of a group and a time that are
published together are packed into one value, or a few where they are many, as Spark hands rows to a processor one by one in Python; the time
stays a column, so what is dropped for its age is judged event by event. The stream is keyed by groups
of about GROUP_FILES files, told by a hash of the file's id; their states are one packed value, so a micro-batch opens the groups of the
files it names and nothing else, however long the history is, and asks the store once a group instead of several times a file. A file that
goes into `processing` is handed out as work with a deadline, and the group's timer stands at its soonest one: if an outcome isn't there when
the watermark has passed the deadline, the file fails. Texts pass through and are never part of a state.

Within a micro-batch a file's events count together, whatever their order and number: first the outcome (the newest, and only of a file
that is processing), then a request to extract again, then a registration, then an extraction. So publishing an event twice changes nothing
beyond what its first copy did. Events older than the watermark are dropped by Spark; a publisher gives `at` as the time of publishing, and
`lateness` is what a publisher may lag behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ledgerloom.session import pickled_by_value
from ledgerloom.streaming.jobs import EXTRACT, REGISTER

EVENT = "file_id string, kind string, name string, outcome string, text string, reason string, at timestamp"
STATE = "file_status string, registration_note string, extraction_status string, extraction_error string, extracted_at long, version long"
CHANGE = f"file_id string, {STATE}, extracted_text string, sets_text boolean, to_extract boolean"
JOB, OUTCOME, AGAIN = "job", "outcome", "again"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: Fixed for the life of a stream's checkpoint, as is the number of files it began with.
GROUP_FILES = 8192
#: Groups to a partition of the state store, as each one's store is written once a micro-batch, whatever it holds.
_GROUPS_A_STORE, _LEAST_STORES = 32, 8
_PACK_BYTES = 1 << 20
_NEVER = np.iinfo(np.int64).max
_HELD = pa.schema([("file_id", pa.string()), *[(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in STATE.split(", ")], ("deadline", pa.int64())])
_ENDS = {"ok": "done", "skipped": "skipped_unsupported", "quarantined": "quarantined"}
_EVENT_COLUMNS = ["file_id", "kind", "name", "outcome", "text", "reason", "at_ms"]
_PACKED = "file_group long, at timestamp, events binary"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGES_ONLY = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"

Workers = Callable[[DataFrame], DataFrame]


def packed(files: pa.Table | pd.DataFrame) -> bytes:
    """The states of a group's files and their deadlines as one value."""
    table = files if isinstance(files, pa.Table) else pa.Table.from_pandas(files, _HELD, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def first_states(key: tuple, files: pa.Table) -> pa.Table:
    """(file_group, held) of the files (file_group, file_id, state) of one group."""
    deadlines = pa.array(np.full(files.num_rows, _NEVER), pa.int64())
    held = packed(files.select(["file_id", *_FIELDS]).append_column("deadline", deadlines).cast(_HELD))
    return pa.table({"file_group": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([held], pa.binary())})


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_group, at, events) of events (file_group, at, then _EVENT_COLUMNS) sorted by group and time: each run of both as packed values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group, at = batch.column(0).to_numpy(), batch.column(1).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text", "reason"))
        part = np.cumsum(size) // _PACK_BYTES
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
        own = pa.Table.from_batches([batch]).select(_EVENT_COLUMNS)
        held = [packed(own.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
        place = pa.array(starts)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(held, pa.binary())], ["file_group", "at", "events"])


class Told:
    """What a micro-batch's events say of the files of a group, by their places in it."""

    def __init__(self, file_ids: pd.Series):
        n = len(file_ids)
        self.places = pd.Index(file_ids)
        self.asked = {name: np.zeros(n, bool) for name in (AGAIN, EXTRACT, REGISTER)}
        self.at, self.newest = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.outcome, self.text, self.reason = (np.full(n, None, object) for _ in range(3))

    def take(self, events: pd.DataFrame) -> None:
        """Takes in events (file_id, kind, name, outcome, text, reason, at_ms); those on a file that isn't there say nothing."""
        place = self.places.get_indexer(events["file_id"])
        events, place = events[place >= 0], place[place >= 0]
        ends, at = (events["kind"] == OUTCOME).to_numpy(), events["at_ms"].to_numpy(np.int64)
        np.maximum.at(self.at, place, at)
        word = events["name"].where(events["kind"] == JOB, events["kind"])
        for name, flag in self.asked.items():
            flag[place[~ends & (word == name).to_numpy()]] = True
        order = np.flatnonzero(ends)
        order = order[np.argsort(-at[order], kind="stable")]
        own, first = np.unique(place[order], return_index=True)
        newer = at[order[first]] > self.newest[own]
        own, rows = own[newer], order[first][newer]
        self.newest[own] = at[rows]
        for held, column in ((self.outcome, "outcome"), (self.text, "text"), (self.reason, "reason")):
            held[own] = events[column].to_numpy(object)[rows]


def _registered_at(at: np.ndarray) -> np.ndarray:
    return np.char.add(np.char.add("registered_at=", np.datetime_as_string(at.astype("datetime64[ms]"), unit="ms")), "Z").astype(object)


class FileStates(StatefulProcessor):
    """The lives of a group's files. Emits a row for each change."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("files", "held binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((bytes(initialState["held"].iloc[0]),))

    def _keep(self, files: pd.DataFrame, soonest: int, changed: np.ndarray) -> None:
        """The states after a micro-batch, and the timer where the soonest deadline isn't the one before."""
        files["version"] += changed.astype(np.int64)
        self.state.update((packed(files),))
        now = files["deadline"].min()
        if now != soonest:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now < _NEVER:
                self.handle.registerTimer(int(now))

    def _emitted(self, files: pd.DataFrame, text: np.ndarray, sets_text: np.ndarray, starts: np.ndarray, changed: np.ndarray) -> pd.DataFrame:
        told = files.drop(columns="deadline").assign(extracted_text=text, sets_text=sets_text, to_extract=starts)
        return told[changed].reset_index(drop=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is None:  # no file is there that these jobs could be on
            for _ in rows:
                pass
            return
        files = unpacked(held[0])
        told = Told(files["file_id"])
        for events in rows:
            told.take(events)
        file_status, note, status, error, deadline = (files[c].to_numpy(object).copy() for c in ("file_status", "registration_note", "extraction_status", "extraction_error", "deadline"))
        extracted_at, text = files["extracted_at"].copy(), np.full(len(files), None, object)

        ended = (told.newest >= 0) & (status == "processing")
        found = told.outcome == "ok"
        status[ended] = [_ENDS.get(outcome, "failed") for outcome in told.outcome[ended]]
        error[ended] = np.where(found, None, told.reason)[ended]
        text[ended] = np.where(found, told.text, None)[ended]
        extracted_at[ended] = told.newest[ended]

        again = told.asked[AGAIN] & (file_status == "registration_done")
        status[again], error[again], text[again], extracted_at[again] = "pending", None, None, pd.NA
        registers = told.asked[REGISTER] & (file_status == "stored")
        starts = told.asked[EXTRACT] & (file_status == "registration_done") & ~np.isin(status.astype(str), ("done", "processing")) | registers
        file_status[registers], note[registers] = "registration_done", _registered_at(told.at[registers])
        status[starts] = "processing"
        deadline[(status != "processing") | starts] = _NEVER
        deadline[starts] = np.maximum(told.at[starts], timerValues.getCurrentWatermarkInMs()) + self.timeout_ms

        changed = ended | again | starts
        if changed.any():
            soonest = files["deadline"].min()
            new = {"file_status": file_status, "registration_note": note, "extraction_status": status, "extraction_error": error, "extracted_at": extracted_at}
            files = files.assign(**new, deadline=pd.array(deadline, "Int64"))
            self._keep(files, soonest, changed)
            yield self._emitted(files, text, ended | again, starts, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Files whose deadline has passed fail at that time, each at its own."""
        files = unpacked(self.state.get()[0])
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        late = (files["deadline"] <= passed).to_numpy(bool)
        if late.any():
            soonest = files["deadline"].min()
            files.loc[late, "extracted_at"] = files.loc[late, "deadline"]
            files.loc[late, ["extraction_status", "extraction_error"]] = ["failed", "timed out"]
            files.loc[late, "deadline"] = _NEVER
            self._keep(files, soonest, late)
            nothing = np.full(len(files), None, object)
            yield self._emitted(files, nothing, late, np.zeros(len(files), bool), late)


class PackedEvents(FileStates):
    """The same on rows of packed events."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = (pa.ipc.open_stream(held).read_pandas() for some in rows for held in some["events"])
        yield from FileStates.handleInputRows(self, key, events, timerValues)


@contextmanager
def _settings(spark: SparkSession, **held: str):
    """Settings for what is started inside; the session's own come back afterwards."""
    own = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


class FileStream:
    """Files and their events in a folder: `files` as they were first, `events`, `changes` by micro-batch, `checkpoint`.

    workers takes (file_id) of the files handed out and gives (file_id, kind, text, reason, at) of those that came to an end; what it leaves
    out stays in processing until its timer.
    """

    def __init__(self, spark: SparkSession, folder: str, workers: Workers, timeout_ms: int = 3_600_000, lateness: str = "10 minutes"):
        self.spark, self.folder, self.workers, self.lateness = spark, folder.rstrip("/"), workers, lateness
        self.timeout_ms, self.handed_out = timeout_ms, False

    def create(self, files: DataFrame) -> None:
        """The files as they are before the first event: file_id and the columns of a file's state and text."""
        at = F.unix_millis(F.col("extracted_at").cast("timestamp")).alias("extracted_at")
        kept = files.select("file_id", "file_status", "registration_note", "extraction_status", "extracted_text", "extraction_error", at)
        kept.write.parquet(f"{self.folder}/files")

    def _groups(self) -> int:
        """By the number of files the stream began with."""
        return 1 + self.spark.read.parquet(f"{self.folder}/files").filter("file_id IS NOT NULL").count() // GROUP_FILES

    def publish(self, events: DataFrame) -> None:
        """Events with any of the columns of EVENT, on the files that were created; other columns are null."""
        columns = [F.col(c).cast(t).alias(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in EVENT.split(", "))]
        told = events.select(*columns).withColumn("at_ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
        group = F.pmod(F.xxhash64("file_id"), F.lit(self._groups())).alias("file_group")
        sorted_rows = told.select(group, "at", *_EVENT_COLUMNS).repartition("file_group").sortWithinPartitions("file_group", "at")
        with _settings(self.spark, **{_BATCH_BYTES: "8m"}), pickled_by_value(__name__):
            sorted_rows.mapInArrow(packs, _PACKED).write.mode("append").parquet(f"{self.folder}/events")

    def publish_jobs(self, files: DataFrame, name: str, at: Column) -> None:
        self.publish(files.select("file_id", F.lit(JOB).alias("kind"), F.lit(name).alias("name"), at.alias("at")))

    def _step(self, changes: DataFrame, batch: int) -> None:
        """A batch that runs again overwrites its changes; its outcomes, told twice, change nothing."""
        path = f"{self.folder}/changes/batch={batch}"
        changes.write.mode("overwrite").parquet(path)
        work = self.spark.read.schema(CHANGE).parquet(path).filter("to_extract")
        if work.isEmpty():
            return
        self.handed_out = True
        told = self.workers(work.select("file_id"))
        self.publish(told.select("file_id", F.lit(OUTCOME).alias("kind"), F.col("kind").alias("outcome"), "text", "reason", "at"))

    def start(self) -> StreamingQuery:
        """One run over all events that are there; the first run takes the files' first states, a later one goes on from the state store."""
        files = self.spark.read.parquet(f"{self.folder}/files").filter("file_id IS NOT NULL")
        groups = self._groups()
        group = F.pmod(F.xxhash64("file_id"), F.lit(groups)).alias("file_group")
        grouped = self.spark.readStream.schema(_PACKED).parquet(f"{self.folder}/events").withWatermark("at", self.lateness).groupBy("file_group")
        first = files.dropDuplicates(["file_id"]).withColumn("version", F.lit(0).cast("long")).select(group, "file_id", *_FIELDS)
        with pickled_by_value(__name__):
            held = first.groupBy("file_group").applyInArrow(first_states, "file_group long, held binary")
            states = PackedEvents(self.timeout_ms)
            changes = grouped.transformWithStateInPandas(states, CHANGE, "append", "eventTime", held.groupBy("file_group"))
        stream = changes.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.folder}/checkpoint")
        stores = str(min(max(_LEAST_STORES, 1 + groups // _GROUPS_A_STORE), int(self.spark.conf.get(_PARTITIONS))))
        with _settings(self.spark, **{_PROVIDER: _ROCKS_DB, _CHANGES_ONLY: "true", _PARTITIONS: stores, _BATCH_BYTES: "8m"}):
            return stream.outputMode("append").trigger(availableNow=True).start()

    def run(self) -> None:
        """Runs until no file is handed out any more, so that outcomes told by workers are taken in too."""
        self.handed_out = True
        while self.handed_out:
            self.handed_out = False
            self.start().awaitTermination()

    def current(self) -> DataFrame:
        """The files as they are now: the newest states, and the text of the newest change that sets one. Read once, not for each batch."""
        files = self.spark.read.parquet(f"{self.folder}/files")
        changes = self.spark.read.schema(f"{CHANGE}, batch int").parquet(f"{self.folder}/changes")
        newest = F.max_by(F.struct(*_FIELDS[:-1]), "version").alias("now")
        text = F.max_by("extracted_text", F.when(F.col("sets_text"), F.col("version"))).alias("new_text")
        told = changes.groupBy("file_id").agg(newest, text, F.bool_or("sets_text").alias("told_text"))
        both = files.join(told, "file_id", "left")
        states = [F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in _FIELDS[:-1]]
        kept = F.when(F.col("told_text"), F.col("new_text")).otherwise(F.col("extracted_text")).alias("extracted_text")
        return both.select("file_id", *states, kept).withColumn("extracted_at", F.timestamp_millis("extracted_at"))
