"""Life cycles of records, files and analyses over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import contracts
from ledgerloom.operators import lifecycles
from ledgerloom.plans.records import order_files
from ledgerloom.plans.registry import register
from ledgerloom.plans.strings import FAULTS, model_output
from ledgerloom.session import table


@register(
    "W2_activation",
    """
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000) THEN 'active'
                           WHEN c_acctbal < 0 THEN 'archived' ELSE 'draft' END AS status FROM customer
    """,
)
def w2_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records, orders as uploads to them; only some are stored."""
    records = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "archived").otherwise("draft").alias("status"))
    stored = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200_000)
    return lifecycles.activate(records, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", stored)


@register(
    "Q5_reextract",
    """
    WITH r AS (
      SELECT e.event_id, e.user_id, CASE WHEN o.o_orderkey IS NULL THEN 'not_found' WHEN o.o_orderstatus <> 'P' THEN 'bad_file_status' ELSE 'ok' END AS result, e.event_id * 7 % 20000 AS k
      FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id * 7 % 20000
    ), g AS (SELECT * FROM r WHERE result = 'ok')
    SELECT 'request' AS kind, CAST(event_id AS VARCHAR) AS id, result AS told, CAST(k AS VARCHAR) AS file_id FROM r
    UNION ALL SELECT 'job', CAST(event_id AS VARCHAR), 'tender.extractText', CAST(k AS VARCHAR) FROM g
    UNION ALL SELECT 'audit', CAST(user_id AS VARCHAR), 'admin.reextract_tender_file TenderFile 2024-02-01 00:00:00', CAST(k AS VARCHAR) FROM g
    UNION ALL SELECT 'file', NULL, CASE WHEN o_orderstatus <> 'P' THEN 'none' WHEN o_orderkey IN (SELECT k FROM g) OR o_custkey % 2 = 1 THEN 'pending' ELSE 'done' END, CAST(o_orderkey AS VARCHAR) FROM orders
    """,
)
def q5_reextract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for the extraction of an order's file again: what becomes of the requests, the jobs, the audit rows and the files."""
    files = order_files(spark, sf_dir)
    wanted = (F.col("event_id") * 7 % 20_000).cast("string").alias("file_id")
    asked = table(spark, sf_dir, "events").select(wanted, F.col("event_id").cast("string").alias("request_id"), F.col("user_id").cast("string").alias("actor"))
    judged = lifecycles.judge_reextraction(files, asked)
    after, jobs, audit = lifecycles.reextract(files, judged, "actor", F.lit("2024-02-01").cast("timestamp_ntz"))
    what = F.concat_ws(" ", "action", "target_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    none = F.lit(None).cast("string")
    parts = [
        judged.select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), F.col("result").alias("told"), "file_id"),
        jobs.select(F.lit("job"), "job_id", "name", "file_id"),
        audit.select(F.lit("audit"), "actor_user_id", what, "target_id"),
        after.select(F.lit("file"), none, "extraction_status", "file_id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_ANALYSES = f"""
    WITH e AS (
      SELECT event_id, user_id, event_type, value / 90 AS c, event_id % {FAULTS} AS fault, event_id % 11 = 0 AS blank, event_id % 13 = 5 AS broke, event_id % 17 = 3 AS open FROM events
    ), j AS (
      SELECT *, CASE WHEN fault IN (1, 2) THEN 'json_parse_failed' WHEN fault IN (3, 4, 5) OR c NOT BETWEEN 0 AND 1 THEN 'schema_mismatch' ELSE 'ok' END AS verdict FROM e
    ), s AS (
      SELECT *, CASE WHEN blank THEN 'no_extracted_text' WHEN open THEN 'processing' WHEN broke OR verdict <> 'ok' THEN 'failed' ELSE 'done' END AS status FROM j
    )
"""


def _analyses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analyses begun for each event, the fields they had, and their outcomes: some calls broke, some haven't come back."""
    events, number = table(spark, sf_dir, "events"), F.col("event_id")
    corpus = F.when(number % 11 == 0, " \n\t ").otherwise(F.col("props"))
    begun = lifecycles.start_analyses(events.select(F.col("user_id").alias("record_id"), number.alias("analysis_id"), corpus.alias("corpus")))
    none = F.lit(None).cast("string")
    analyses = begun.select("*", none.alias("summary"), none.alias("raw_output"), none.alias("model"), F.lit("old").alias("error"))
    old = events.select(
        number.alias("analysis_id"), F.lit("old").alias("field_key"), F.lit("l").alias("field_label"), F.lit("v").alias("value_text"), F.lit(0.5).alias("confidence"), F.lit(0).alias("sort_order")
    )
    broke, model = number % 13 == 5, F.concat(F.lit("m"), (number % 3).cast("string"))
    answered = events.filter(number % 17 != 3).withColumn("raw_output", F.when(broke, None).otherwise(model_output()))
    checked = F.when(~broke, contracts.parse_result(F.col("raw_output")))
    outcomes = answered.select(number.alias("analysis_id"), "raw_output", F.when(~broke, model).alias("model"), F.when(broke, "Error: timeout").alias("error"), checked.alias("r"))
    return analyses, old, outcomes


@register(
    "W4_analysis_states",
    _ANALYSES
    + """
    SELECT event_id AS analysis_id, status, CASE WHEN status = 'done' THEN CASE fault WHEN 7 THEN 'last' ELSE event_type END END AS summary,
           CASE WHEN status IN ('done', 'failed') AND NOT broke THEN 'm' || event_id % 3 END AS model,
           CASE WHEN status IN ('processing', 'no_extracted_text') THEN 'old' WHEN status = 'failed' THEN CASE WHEN broke THEN 'Error: timeout' ELSE verdict END END AS error,
           status IN ('done', 'failed') AND NOT broke AS has_output FROM s
    """,
)
def w4_analysis_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses after their outcomes."""
    analyses, _, outcomes = _analyses(spark, sf_dir)
    after = lifecycles.finish_analyses(analyses, outcomes)
    return after.select("analysis_id", "status", "summary", "model", "error", F.col("raw_output").isNotNull().alias("has_output"))


@register(
    "W4_analysis_fields",
    _ANALYSES
    + """
    SELECT event_id AS analysis_id, CASE WHEN status = 'done' THEN 'k' ELSE 'old' END AS field_key, CASE WHEN status = 'done' THEN c ELSE 0.5 END AS confidence, CAST(0 AS INTEGER) AS sort_order FROM s
    """,
)
def w4_analysis_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of all analyses after their outcomes: those of finished ones are new, all others are as they were."""
    analyses, old, outcomes = _analyses(spark, sf_dir)
    return lifecycles.replaced_fields(old, analyses, outcomes).select("analysis_id", "field_key", "confidence", "sort_order")


@register("W4_analysis_audit", _ANALYSES + "SELECT user_id AS record_id, '{\"analysisId\":' || event_id || '}' AS meta, 'tender.ai_analyze' AS action FROM s WHERE status = 'done'")
def w4_analysis_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for each analysis that was finished."""
    analyses, _, outcomes = _analyses(spark, sf_dir)
    after = lifecycles.finish_analyses(analyses, outcomes)
    return lifecycles.analysis_audit(analyses, after, "record_id", F.current_timestamp()).select(F.col("target_id").alias("record_id"), "meta", "action")


@register(
    "S6_retention",
    """
    WITH j AS (
      SELECT event_id AS job_id, 'q' || user_id % 3 AS queue, ts AS finished_at,
             CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'waiting' WHEN 'click' THEN 'active' ELSE 'completed' END AS state FROM events
    )
    SELECT job_id, queue, state FROM (SELECT *, row_number() OVER (PARTITION BY queue, state ORDER BY finished_at DESC, job_id DESC) AS place FROM j)
    WHERE state IN ('waiting', 'active') OR (state = 'completed' AND place <= 100) OR (state = 'failed' AND place <= 500)
    """,
)
def s6_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of three queues: what is left of them when each queue keeps its newest hundred completed and five hundred failed ones."""
    kind = F.col("event_type")
    state = F.when(kind == "error", "failed").when(kind == "signup", "waiting").when(kind == "click", "active").otherwise("completed")
    queue = F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string"))
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), queue.alias("queue"), state.alias("state"), F.col("ts").alias("finished_at"))
    return lifecycles.retained_jobs(jobs).select("job_id", "queue", "state")
