"""Tables, objects and job streams written to the shared folder and read back, and run figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import usage
from ledgerloom.plans.records import LOST_SQL, STATES_SQL, order_files, order_outcomes
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder, table
from ledgerloom.sources import files
from ledgerloom.streaming import jobs


@register("K1_append", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def k1_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders inserted into a new table, then all others in bulk, by status."""
    folder, orders = new_folder(spark, "orders"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    files.append(orders.filter("o_orderstatus = 'F'"), folder, ["o_orderstatus"])
    files.append(orders.filter("o_orderstatus <> 'F'"), folder, ["o_orderstatus"])
    return spark.read.parquet(folder).select("o_orderkey", "o_custkey", "o_orderstatus")


@register(
    "K6_json_out",
    "SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind, props FROM events",
)
def k6_json_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, nulls and JSON inside strings included."""
    folder = new_folder(spark, "events")
    kind = F.nullif("event_type", F.lit("view")).alias("kind")
    files.write_json(table(spark, sf_dir, "events").select("event_id", "user_id", kind, "props"), folder)
    back = spark.read.schema("event_id long, user_id long, kind string, props string").json(folder)
    return back.select("event_id", "user_id", "kind", "props")


@register("S4_objects", "SELECT n_nationkey, strlen(n_name) + 1 AS size_bytes, sha256(n_name || chr(10)) AS content_sha256 FROM nation")
def s4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name as an object of its own, read back as bytes under its key."""
    folder = new_folder(spark, "objects")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(folder)
    found = files.accepted_uploads(files.read_objects(spark, folder, "*.txt"))
    key = F.regexp_extract("storage_key", r"n_nationkey=(\d+)/", 1).cast("long").alias("n_nationkey")
    return found.select(key, "size_bytes", F.sha2("content", 256).alias("content_sha256"))


@register(
    "K3_objects",
    """
    SELECT 'companies/' || source || '/documents/' || doc_id || '/versions/1/text_' || lang || '.txt' AS storage_key, strlen(coalesce(text, '')) AS size_bytes,
           sha256(coalesce(text, '')) AS content_sha256, sha256(coalesce(text, '')) AS read_sha256 FROM documents
    """,
)
def k3_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text put under its key as bytes, and read back: the receipts, and the digests of what was found."""
    folder = new_folder(spark, "versions")
    key = text.document_version_key(F.col("source"), F.col("doc_id").cast("string"), F.lit("1"), F.concat(F.lit("text "), "lang", F.lit(".txt")))
    objects = table(spark, sf_dir, "documents").select(key.alias("storage_key"), F.encode("text", "UTF-8").alias("content"))
    receipts = files.write_objects(objects, f"{folder}/objects", f"{folder}/receipts")
    found = files.fetch_objects(receipts, f"{folder}/objects").select("storage_key", F.sha2("content", 256).alias("read_sha256"))
    return receipts.join(found, "storage_key", "left")


@register("S6_job_stream", STATES_SQL)
def s6_job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of Q3_file_states published to a folder in two parts, and taken from it by the stream in as many runs."""
    stored, folder = order_files(spark, sf_dir), new_folder(spark, "job-stream")
    states = jobs.FileTable(spark, f"{folder}/files")
    states.create(stored)
    for name, tag in ((jobs.REGISTER, "a"), (jobs.EXTRACT, "b")):
        asked = stored.select(F.concat(F.lit(tag), "file_id").alias("job_id"), F.lit(name).alias("name"), "file_id")
        jobs.publish(spark, f"{folder}/jobs", asked)
        at = F.lit("2024-02-01").cast("timestamp_ntz")
        jobs.run_stream(spark, f"{folder}/jobs", states, f"{folder}/checkpoint", order_outcomes, at).awaitTermination()
    return states.current().select("file_id", "file_status", "registration_note", "extraction_status", "extracted_text", "extraction_error")


@register("Q4_lost_objects", LOST_SQL)
def q4_lost_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions whose stored object is gone for every fifth order: each such file fails, none stops the batch."""
    stored = order_files(spark, sf_dir)
    asked = stored.select(F.concat(F.lit("c"), "file_id").alias("job_id"), F.lit(jobs.EXTRACT).alias("name"), "file_id")
    after = jobs.apply_jobs(stored, asked, lambda chosen: order_outcomes(chosen.filter("file_id % 5 <> 0")), F.lit("2024-02-01").cast("timestamp_ntz"))
    return after.select("file_id", "extraction_status", "extracted_text", "extraction_error")


@register(
    "K7_run_figures",
    "SELECT count(*) AS calls, sum(length(props)) AS tokens_in, sum(length(event_type)) AS tokens_out, CAST(max(value) AS DOUBLE) AS slowest_ms FROM events",
)
def k7_run_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and the slowest call, observed while the rows are written, without a pass of their own."""
    calls = table(spark, sf_dir, "events").select(
        F.length("props").alias("tokens_in"), F.length("event_type").alias("tokens_out"), F.col("value").cast("double").alias("elapsed_ms")
    )
    observed, figures = usage.observed_calls(calls)
    observed.write.parquet(new_folder(spark, "calls"))
    row = figures.get
    return spark.createDataFrame([tuple(row[c] for c in usage.FIGURES)], "calls long, tokens_in long, tokens_out long, slowest_ms double")
