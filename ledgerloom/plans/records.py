"""Stored files, their texts, their states and their exports, made from the driver tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.registry import register
from ledgerloom.session import table
from ledgerloom.sources import extraction, files
from ledgerloom.sources.settings import ExtractionLimits
from ledgerloom.streaming import jobs

_WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(text: str) -> bytes:
    """A small DOCX file with one paragraph a line."""
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_WORDS}"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


@register(
    "D4_docx_text",
    """
    SELECT conv_id, turn, 'docx' AS format, 'ok' AS kind, sha256(replace(text, chr(10), chr(10) || chr(10))) AS text_sha256 FROM conversations
    """,
)
def d4_docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn stored as a DOCX file and read back through detection and extraction."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[docx_bytes(t or "") for t in batch["text"]])[["file_id", "content"]]

    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    stored = table(spark, sf_dir, "conversations").select(key.alias("file_id"), "text").mapInPandas(pack, "file_id string, content binary")
    named = stored.select("file_id", F.lit("turn.docx").alias("original_name"), F.lit("application/octet-stream").alias("content_type"), "content")
    ids = F.split("file_id", "-")
    return extraction.extract(named).select(
        ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), "format", "kind", F.sha2("text", 256).alias("text_sha256")
    )


def _conversation_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("turn-"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit(".txt"))
    return files.zip_bundles(turns.select(F.col("conv_id").cast("string").alias("id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content")))


@register(
    "K5_bundle_round_trip",
    """
    SELECT CAST(conv_id AS VARCHAR) AS id, 'turn-' || lpad(CAST(turn AS VARCHAR), 6, '0') || '.txt' AS path, sha256(coalesce(text, '')) AS content_sha256
    FROM conversations
    """,
)
def k5_bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a ZIP archive, and the entries read from it."""
    return files.unpack(_conversation_bundles(spark, sf_dir)).select("id", "path", F.sha2("content", 256).alias("content_sha256"))


@register(
    "D8_zip_text",
    """
    SELECT CAST(conv_id AS VARCHAR) AS file_id, 'ok' AS kind,
           string_agg('--- turn-' || lpad(CAST(turn AS VARCHAR), 6, '0') || '.txt ---' || chr(10) || '[skipped:unsupported_format]', chr(10) || chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
    """,
)
def d8_zip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archives expanded under limits; plain text inside has no reader, which each entry's block says."""
    bundles = _conversation_bundles(spark, sf_dir)
    named = bundles.select(F.col("id").alias("file_id"), F.col("filename").alias("original_name"), F.lit("application/zip").alias("content_type"), "content")
    return extraction.extract(named).select("file_id", "kind", "text")


@register(
    "D8_zip_limits",
    """
    WITH t AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 4 = 1 THEN 'a/b/c/d/' ELSE '' END || 'turn-' || lpad(CAST(turn AS VARCHAR), 6, '0') || '.docx' AS name FROM conversations),
         c AS (SELECT conv_id, count(*) AS n, min(name) AS first_name,
                      string_agg('--- ' || name || ' ---' || chr(10) || CASE WHEN length(trim(text, ' ' || chr(10) || chr(9))) = 0 THEN '[skipped:docx_empty]' ELSE trim(replace(text, chr(10), chr(10) || chr(10)), ' ' || chr(10) || chr(9)) END, chr(10) || chr(10) ORDER BY turn) AS text
               FROM t GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS file_id, CASE WHEN n > 4 OR conv_id % 4 = 1 THEN 'quarantined' ELSE 'ok' END AS kind,
           sha256(CASE WHEN n <= 4 AND conv_id % 4 <> 1 THEN CASE WHEN conv_id % 4 = 2 THEN '--- all.zip (nested zip) ---' || chr(10) || text ELSE text END END) AS text_sha256,
           CASE WHEN n > 4 THEN CASE WHEN conv_id % 4 = 2 THEN 'nested:all.zip:' ELSE '' END || 'zip_too_many_files:' || n || '>4'
                WHEN conv_id % 4 = 1 THEN 'zip_path_too_deep:' || first_name END AS reason
    FROM c
    """,
)
def d8_zip_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as DOCX files in an archive, under four files at most and three folders: some are too many, some too deep, some nested."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[docx_bytes(t or "") for t in batch["content"]])

    def nest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[_nested(c) if int(i) % 4 == 2 else c for i, c in zip(batch["file_id"], batch["content"], strict=True)])

    folder = F.when(F.col("conv_id") % 4 == 1, "a/b/c/d/").otherwise("")
    path = F.concat(folder, F.lit("turn-"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit(".docx"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), path.alias("path"), F.col("text").alias("content"))
    bundles = files.zip_bundles(turns.mapInPandas(pack, "id string, path string, content binary")).selectExpr("id AS file_id", "content")
    named = bundles.mapInPandas(nest, "file_id string, content binary").withColumns({"original_name": F.lit("all.zip"), "content_type": F.lit("application/zip")})
    limits = ExtractionLimits(zip_max_files=4, zip_max_depth=3)
    return extraction.extract(named, limits).select("file_id", "kind", F.sha2("text", 256).alias("text_sha256"), "reason")


def _nested(content: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("all.zip", content)
    return out.getvalue()


@register(
    "D9_outcome_state",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'skipped_unsupported' WHEN 'signup' THEN 'quarantined' ELSE 'failed' END AS extraction_status,
           CASE WHEN event_type = 'view' THEN props END AS extracted_text, CASE WHEN event_type <> 'view' THEN event_type END AS extraction_error, ts AS extracted_at FROM events
    """,
)
def d9_outcome_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each outcome writes to a file's row."""
    kind = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "skipped").when(F.col("event_type") == "signup", "quarantined").otherwise("error")
    columns = extraction.outcome_columns(kind, F.col("props"), F.col("event_type"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in columns.items()])


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: open ones are stored, pending ones registered (some extracted already), finished ones not uploaded."""
    status = F.when(F.col("o_orderstatus") == "O", "stored").when(F.col("o_orderstatus") == "P", "registration_done").otherwise("pending_upload")
    state = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 2 == 0, "done").otherwise("pending")).otherwise("none")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.col("o_custkey").alias("owner"),
        status.alias("file_status"),
        none.alias("registration_note"),
        state.alias("extraction_status"),
        none.alias("extracted_text"),
        none.alias("extraction_error"),
        F.lit(None).cast("timestamp_ntz").alias("extracted_at"),
    )


def order_outcomes(chosen: DataFrame) -> DataFrame:
    """An extractor by rule: the owner's number tells the outcome."""
    kinds = F.array(F.lit("ok"), F.lit("skipped"), F.lit("error"))
    kind = F.element_at(kinds, (F.col("owner") % 3 + 1).cast("int"))
    return chosen.select("file_id", kind.alias("kind"), F.when(kind == "ok", F.concat(F.lit("text "), "file_id")).alias("text"), F.when(kind != "ok", F.lit("why")).alias("reason"))


STATES_SQL = """
    WITH f AS (SELECT *, o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_custkey % 2 = 1) AS runs FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CASE o_orderstatus WHEN 'F' THEN 'pending_upload' ELSE 'registration_done' END AS file_status,
           CASE WHEN o_orderstatus = 'O' THEN 'registered_at=2024-02-01T00:00:00.000Z' END AS registration_note,
           CASE WHEN runs THEN CASE o_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped_unsupported' ELSE 'failed' END
                WHEN o_orderstatus = 'P' THEN 'done' ELSE 'none' END AS extraction_status,
           CASE WHEN runs AND o_custkey % 3 = 0 THEN 'text ' || o_orderkey END AS extracted_text,
           CASE WHEN runs AND o_custkey % 3 <> 0 THEN 'why' END AS extraction_error
    FROM f
    """

#: Only the extractions are asked for, and every fifth order's object is gone.
LOST_SQL = """
    WITH f AS (SELECT *, o_orderstatus = 'P' AND o_custkey % 2 = 1 AS runs, o_orderkey % 5 = 0 AS gone FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS file_id,
           CASE WHEN runs AND gone THEN 'failed' WHEN runs THEN CASE o_custkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped_unsupported' ELSE 'failed' END
                WHEN o_orderstatus = 'P' THEN 'done' ELSE 'none' END AS extraction_status,
           CASE WHEN runs AND NOT gone AND o_custkey % 3 = 0 THEN 'text ' || o_orderkey END AS extracted_text,
           CASE WHEN runs AND gone THEN 's3_download:object not found' WHEN runs AND o_custkey % 3 <> 0 THEN 'why' END AS extraction_error
    FROM f
"""


@register("Q3_file_states", STATES_SQL)
def q3_file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after a batch that asks for every file's registration, twice, and every file's extraction."""
    stored = order_files(spark, sf_dir)
    ask = lambda name, tag: stored.select(F.concat(F.lit(tag), "file_id").alias("job_id"), F.lit(name).alias("name"), "file_id")
    batch = ask(jobs.REGISTER, "a").unionByName(ask(jobs.REGISTER, "b")).unionByName(ask(jobs.EXTRACT, "c"))
    after = jobs.apply_jobs(stored, batch, order_outcomes, F.lit("2024-02-01").cast("timestamp_ntz"))
    return after.select("file_id", "file_status", "registration_note", "extraction_status", "extracted_text", "extraction_error")


@register(
    "Q1_job_results",
    """
    SELECT e.event_id, CASE e.event_type
        WHEN 'view' THEN CASE WHEN o.o_orderkey IS NULL THEN 'file_not_found' WHEN o.o_orderstatus = 'O' THEN 'ok' ELSE 'unexpected_status' END
        WHEN 'click' THEN CASE WHEN o.o_orderkey IS NULL THEN 'file_not_found' WHEN o.o_orderstatus <> 'P' THEN 'unexpected_file_status'
                               WHEN o.o_custkey % 2 = 0 THEN 'skipped' ELSE 'ok' END
        WHEN 'signup' THEN 'ok' ELSE 'unknown_job' END AS result
    FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id
    """,
)
def q1_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a job on the order of its number, and what becomes of it."""
    name = F.when(F.col("event_type") == "view", jobs.REGISTER).when(F.col("event_type") == "click", jobs.EXTRACT).when(F.col("event_type") == "signup", "tender.parse")
    asked = table(spark, sf_dir, "events").select("event_id", F.coalesce(name, F.lit("other")).alias("name"), F.col("event_id").cast("string").alias("file_id"))
    return jobs.route(asked, order_files(spark, sf_dir)).select("event_id", "result")


@register(
    "Q5_request_again",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'none' END AS extraction_status FROM orders
    """,
)
def q5_request_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered file asked for once more; the others stay."""
    stored = order_files(spark, sf_dir)
    return jobs.request_again(stored, stored.select("file_id")).select("file_id", "extraction_status")


@register("S5_accepted_sizes", "SELECT doc_id, strlen(text) BETWEEN 1 AND 20000 AS accepted FROM documents")
def s5_accepted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as uploads under a limit of 20,000 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", files.valid_upload(F.octet_length("text"), 20_000).alias("accepted"))
