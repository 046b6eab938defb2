"""The job queue as a data source."""

import tracemalloc

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.sources import queue
from ledgerloom.sources.queue import FORMAT, Written, _Folder


@pytest.fixture
def publish(spark, tmp_path):
    queue.register_queue(spark)
    folder = f"file://{tmp_path}/q"

    def run(ids, parts=2):
        rows = spark.createDataFrame([(i, "tender.parse", None if i.endswith("0") else f"f{i}") for i in ids], queue.SCHEMA)
        rows.repartition(parts).write.format(FORMAT).option("path", folder).mode("append").save()

    run.folder = folder
    return run


def take(spark, publish, tmp_path, **options):
    """What a run of the stream brings."""
    before = set(read_back(spark, tmp_path))
    stream = spark.readStream.format(FORMAT).option("path", publish.folder).options(**options).load()
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return sorted(set(read_back(spark, tmp_path)) - before)


def read_back(spark, tmp_path):
    if not (tmp_path / "out").exists():
        return []
    return [r.job_id for r in spark.read.schema(queue.SCHEMA).parquet(f"{tmp_path}/out").collect()]


def test_batches_and_streams(spark, publish, tmp_path):
    publish(["1", "2", "30"])
    publish([])
    rows = spark.read.format(FORMAT).option("path", publish.folder).load()
    assert sorted((r.job_id, r.file_id) for r in rows.collect()) == [("1", "f1"), ("2", "f2"), ("30", None)]
    assert take(spark, publish, tmp_path) == ["1", "2", "30"]
    assert take(spark, publish, tmp_path) == []
    publish(["4", "5"], parts=5)
    publish(["6"])
    assert take(spark, publish, tmp_path) == ["4", "5", "6"]
    assert len(read_back(spark, tmp_path)) == 6
    with pytest.raises(Exception, match="only appended"):
        rows.write.format(FORMAT).option("path", publish.folder).mode("overwrite").save()


def test_a_failed_write_leaves_nothing_to_read(spark, publish):
    publish(["1"])
    bad = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("job_id"), F.lit("n").alias("name"), F.lit("f").alias("file_id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format(FORMAT).option("path", publish.folder).mode("append").save()
    assert [r.job_id for r in spark.read.format(FORMAT).option("path", publish.folder).load().collect()] == ["1"]


def test_entries_that_a_stream_is_done_with_go(spark, publish, tmp_path):
    for i in range(5):
        publish([str(i + 1)], parts=1)
        assert take(spark, publish, tmp_path, retain="1") == [str(i + 1)]
    left = [e["number"] for e in _Folder(publish.folder).entries()]
    assert left[-1] == 4 and len(left) <= 3 and len(_Folder(publish.folder).names("data")) == len(left)
    assert sorted(read_back(spark, tmp_path)) == ["1", "2", "3", "4", "5"]


def test_a_batch_entered_twice_counts_once(tmp_path):
    folder = _Folder(f"file://{tmp_path}/q")
    for n in range(2):
        folder.write(f"data/{n}.jsonl", b'{"job_id": "a"}')
        folder.enter([Written(f"data/{n}.jsonl", 1), None], "s/7")
    assert [e["files"] for e in folder.entries()] == [[{"path": "data/0.jsonl", "jobs": 1}]] and folder.names("data") == ["0.jsonl"]
    assert folder.claim("log/000000000000", b"{}") is False and folder.next_number() == 1


def test_a_stream_writes_to_a_queue(spark, publish, tmp_path):
    publish(["1", "2"])
    stream = spark.readStream.format(FORMAT).option("path", publish.folder).load().withColumn("job_id", F.concat(F.lit("again "), "job_id"))
    for _ in range(2):
        stream.writeStream.format(FORMAT).option("path", f"{publish.folder}-2").option("tag", "copy").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.format(FORMAT).option("path", f"{publish.folder}-2").load()
    assert sorted(r.job_id for r in rows.collect()) == ["again 1", "again 2"]


def test_a_write_holds_no_more_than_a_piece(tmp_path):
    """A task wrote its lines from one list, and read its file as a whole."""
    folder, n, row = f"file://{tmp_path}/q", 300_000, Row(job_id="a" * 100, name="é\u2028\x85\n", file_id=None)
    tracemalloc.start()
    try:
        written = queue._write(folder, (row for _ in range(n)))
        found = sum(1 for job in queue._read(folder, ["job_id", "name", "file_id"], written.path) if job == tuple(row))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == written.jobs == n and peak < 20 << 20
    assert queue._write(folder, iter(())).jobs == 0 and len(_Folder(folder).names("data")) == 1

    def broken():
        yield row
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        queue._write(folder, broken())
    assert len(_Folder(folder).names("data")) == 1
