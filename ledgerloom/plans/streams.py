"""Streams beyond the reference's queue: file states in a state store, and event-time windows with late rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.records import LOST_SQL, STATES_SQL, order_files, order_outcomes
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder, table
from ledgerloom.sources.queue import FORMAT, register_queue
from ledgerloom.streaming import jobs
from ledgerloom.streaming.states import FileStream
from ledgerloom.streaming.windows import SESSION, SLIDING, TUMBLING, EventTime, window_of

_AT = "2024-02-01 00:00:00"


def _order_stream(spark: SparkSession, sf_dir: str, gone: str = "false") -> FileStream:
    """Orders as files; workers find the owner of what they are handed and tell nothing of files that are gone."""
    owners = order_files(spark, sf_dir).select("file_id", "owner")

    def workers(work: DataFrame) -> DataFrame:
        found = owners.join(work, "file_id", "left_semi").filter(f"NOT ({gone})")
        return order_outcomes(found).withColumn("at", F.lit(_AT).cast("timestamp"))

    stream = FileStream(spark, new_folder(spark, "file-states"), workers)
    stream.create(order_files(spark, sf_dir))
    return stream


@register("E_keyed_file_states", STATES_SQL)
def e_keyed_file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of Q3_file_states, registrations and then extractions, each taken by runs of their own over states in a state store."""
    stream, asked = _order_stream(spark, sf_dir), order_files(spark, sf_dir)
    for name in (jobs.REGISTER, jobs.EXTRACT):
        stream.publish_jobs(asked, name, F.lit(_AT).cast("timestamp"))
        stream.run()
    return stream.current().select("file_id", "file_status", "registration_note", "extraction_status", "extracted_text", "extraction_error")


@register("E_stuck_files", LOST_SQL.replace("s3_download:object not found", "timed out"))
def e_stuck_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions that nobody reports on for every fifth order: timers fail those files once an event tells that time has come so far."""
    stream = _order_stream(spark, sf_dir, "file_id % 5 = 0")
    stream.publish_jobs(order_files(spark, sf_dir), jobs.EXTRACT, F.lit(_AT).cast("timestamp"))
    stream.run()
    later = spark.range(1).select(F.lit("").alias("file_id"))
    stream.publish_jobs(later, "tender.parse", F.lit(_AT).cast("timestamp") + F.expr("INTERVAL 2 HOURS"))
    stream.run()
    return stream.current().select("file_id", "extraction_status", "extracted_text", "extraction_error")


@register(
    "E_job_queue",
    """
    SELECT 'r' || o_orderkey AS job_id, 'tender.fileRegistered' AS name, CAST(o_orderkey AS VARCHAR) AS file_id FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'x' || o_orderkey, 'tender.extractText', CASE WHEN o_custkey % 10 > 0 THEN CAST(o_orderkey AS VARCHAR) END FROM orders WHERE o_orderstatus <> 'F'
    """,
)
def e_job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs on orders put into a queue twice, each time taken from it by a run of a stream that reads the queue as a data source."""
    register_queue(spark)
    folder, orders = new_folder(spark, "queue"), table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    stream = spark.readStream.format(FORMAT).option("path", f"{folder}/queue").load()
    for tag, name, chosen in (("r", jobs.REGISTER, F.col("o_orderstatus") == "O"), ("x", jobs.EXTRACT, F.col("o_orderstatus") != "F")):
        file_id = F.when((F.col("o_custkey") % 10 > 0) | F.lit(tag == "r"), key)
        asked = orders.filter(chosen).select(F.concat(F.lit(tag), key).alias("job_id"), F.lit(name).alias("name"), file_id.alias("file_id"))
        asked.write.format(FORMAT).option("path", f"{folder}/queue").mode("append").save()
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/taken").option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/taken")


#: Events arrive in parts of ten days, every fiftieth of them three days later, with a lateness of one day.
_JUDGED = """
    WITH a AS (
      SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE) + CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END) // 10 AS part FROM events
    ), p AS (
      SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a GROUP BY part
    ), j AS (
      SELECT a.*, coalesce(a.ts < p.seen - INTERVAL 1 DAY, FALSE) AS late FROM a JOIN p ON a.part = p.part
    ), t AS (SELECT * FROM j WHERE NOT late), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM t)
"""


def _event_time(spark: SparkSession, sf_dir: str) -> EventTime:
    """All events, arrived part by part and judged, each part by a run of its own."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    streams = EventTime(spark, new_folder(spark, "event-time"), rows.schema, "ts", "1 day")
    day = F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 50 == 0, 3).otherwise(0))
    parted = rows.withColumn("part", F.floor(F.datediff(day, F.lit("2024-01-01")) / 10))
    for part in range(parted.agg(F.max("part")).first()[0] + 1):
        streams.arrive(parted.filter(F.col("part") == part))
        streams.part_late_rows().awaitTermination()
    return streams


def _counted(spark: SparkSession, sf_dir: str, kind: str, keys: list[str], length: str, slide: str | None = None) -> DataFrame:
    streams = _event_time(spark, sf_dir)
    sums = [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")]
    streams.count_windows(kind, window_of(kind, "ts", length, slide), keys, sums).awaitTermination()
    found = streams.windows(kind)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@register("E_late_rows", _JUDGED + "SELECT event_id, user_id, ts, part FROM j WHERE late")
def e_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that came too late, with the part that brought them."""
    late = _event_time(spark, sf_dir).late_rows()
    return late.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("batch").cast("long").alias("part"))


@register(
    "E_tumbling_windows",
    _JUDGED
    + """
    , s AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM t)
    SELECT event_type, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM s WHERE window_start + INTERVAL 6 HOUR <= (SELECT mark FROM m) GROUP BY event_type, window_start
    """,
)
def e_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time by type in windows of six hours, once the watermark has passed them."""
    return _counted(spark, sf_dir, TUMBLING, ["event_type"], "6 hours")


@register(
    "E_sliding_windows",
    _JUDGED
    + """
    , s AS (
      SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS window_start FROM t, (SELECT unnest([0, 1, 2, 3]) AS k)
    )
    SELECT event_type, window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM s WHERE window_start + INTERVAL 1 DAY <= (SELECT mark FROM m) GROUP BY event_type, window_start
    """,
)
def e_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows of a day that begin every six hours."""
    return _counted(spark, sf_dir, SLIDING, ["event_type"], "1 day", "6 hours")


@register(
    "E_session_windows",
    _JUDGED
    + """
    , g AS (
      SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS begins, event_id FROM t
    ), s AS (
      SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g
    )
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT mark FROM m)
    """,
)
def e_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which end after twelve hours without an event."""
    return _counted(spark, sf_dir, SESSION, ["user_id"], "12 hours")
