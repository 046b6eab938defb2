"""Life cycles of records, files and analyses: what a batch of requests does to their tables, each request judged by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.writes import audit_event, update_by_key
from ledgerloom.streaming.jobs import EXTRACT

OK, NOT_FOUND, BAD_STATUS, NO_TEXT = "ok", "not_found", "bad_file_status", "no_extracted_text"
REEXTRACT = "admin.reextract_tender_file"
ANALYSE = "tender.ai_analyze"


#: How many finished jobs a queue keeps, by how they ended.
KEPT_COMPLETED, KEPT_FAILED = 100, 500


def retained_jobs(jobs: DataFrame, completed: int = KEPT_COMPLETED, failed: int = KEPT_FAILED) -> DataFrame:
    """Jobs (job_id, queue, state, finished_at, ...) that a queue keeps: of each queue the newest that completed, the newest that failed, and
    all that haven't ended. Every task drops what can't be among the newest before anything is shuffled."""
    ended = F.col("state").isin("completed", "failed")
    newest = Window.partitionBy("queue", "state").orderBy(F.desc_nulls_last("finished_at"), F.desc("job_id"))
    ranked = jobs.filter(ended).withColumn("__place", F.row_number().over(newest)).filter(F.col("__place") <= max(completed, failed))
    kept = ranked.filter(F.col("__place") <= F.when(F.col("state") == "completed", completed).otherwise(failed)).drop("__place")
    return kept.unionByName(jobs.filter(~F.coalesce(ended, F.lit(False))))


def activate(parents: DataFrame, uploads: DataFrame, key: str, upload_key: str, stored: Column) -> DataFrame:
    """Records or documents after a batch of uploads: those with an upload that was stored become active, whatever they were."""
    active = uploads.filter(stored & F.col(upload_key).isNotNull()).select(F.col(upload_key).alias(key)).distinct()
    return update_by_key(parents, active.withColumn("status", F.lit("active")), key)


def judge_reextraction(files: DataFrame, asked: DataFrame) -> DataFrame:
    """The columns of asked (file_id, ...) and result: only a registered file may be extracted again."""
    states = files.select(F.col("file_id").alias("__id"), F.col("file_status").alias("__status"))
    met = asked.join(states, F.col("file_id") == F.col("__id"), "left")
    result = F.when(F.col("__id").isNull(), NOT_FOUND).when(F.coalesce(F.col("__status") != "registration_done", F.lit(True)), BAD_STATUS).otherwise(OK)
    return met.select(*asked.columns, result.alias("result"))


def reextract(files: DataFrame, judged: DataFrame, actor: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After judged requests (file_id, request_id, actor, result): the files, the jobs to publish, and the audit rows.

    A file is reset once however often it is asked for; each request that was granted is a job and an audit row of its own.
    """
    granted = judged.filter(F.col("result") == OK)
    nothing = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in ("extracted_text", "extraction_error", "extracted_at")]
    reset = granted.select("file_id").distinct().select("file_id", F.lit("pending").alias("extraction_status"), *nothing)
    jobs = granted.select(F.col("request_id").alias("job_id"), F.lit(EXTRACT).alias("name"), "file_id")
    meta = F.lit(None).cast("struct<none:string>")
    audit = granted.select(*audit_event(F.col(actor), REEXTRACT, "TenderFile", F.col("file_id"), meta, at))
    return update_by_key(files, reset, "file_id"), jobs, audit


def start_analyses(corpora: DataFrame) -> DataFrame:
    """The columns of corpora (record_id, analysis_id, corpus) but the corpus, with status: processing, or no_extracted_text where it is blank."""
    blank = F.coalesce(F.trim(F.regexp_replace("corpus", r"\s+", " ")) == "", F.lit(True))
    return corpora.withColumn("status", F.when(blank, NO_TEXT).otherwise("processing")).drop("corpus")


def finish_analyses(analyses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Analyses (analysis_id, status, summary, raw_output, model, error) after outcomes (analysis_id, raw_output, model, error, r).

    r is the checked output. An error of the call fails the analysis with what is known; an output against the contract fails it with the
    fault's name; a good one makes it done, with its summary and without an error. Only analyses in processing change.
    """
    told = outcomes.withColumnsRenamed({c: f"__{c}" for c in outcomes.columns if c != "analysis_id"})
    met = analyses.join(told, "analysis_id", "left")
    changed = (F.col("status") == "processing") & (F.col("__error").isNotNull() | F.col("__r").isNotNull())
    good = changed & F.col("__error").isNull() & (F.col("__r.status") == OK)
    error = F.coalesce("__error", "__r.status")
    new = {
        "status": F.when(good, "done").when(changed, "failed").otherwise(F.col("status")),
        "summary": F.when(good, F.col("__r.summary")).otherwise(F.col("summary")),
        "raw_output": F.when(changed, F.col("__raw_output")).otherwise(F.col("raw_output")),
        "model": F.when(changed, F.col("__model")).otherwise(F.col("model")),
        "error": F.when(good, None).when(changed, error).otherwise(F.col("error")),
    }
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in analyses.columns])


def replaced_fields(fields: DataFrame, before: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fields (analysis_id, field_key, field_label, value_text, confidence, sort_order) after outcomes: those of analyses that become done are
    replaced as a whole, in the order of the output; all others stay."""
    running = before.filter("status = 'processing'").select("analysis_id")
    good = outcomes.filter(F.col("error").isNull() & (F.col("r.status") == OK)).join(running, "analysis_id", "left_semi")
    each = good.select("analysis_id", F.posexplode("r.fields").alias("sort_order", "f"))
    new = each.select(
        "analysis_id", F.col("f.key").alias("field_key"), F.col("f.label").alias("field_label"), F.col("f.value").alias("value_text"), F.col("f.confidence").alias("confidence"), "sort_order"
    )
    return fields.join(good.select("analysis_id"), "analysis_id", "left_anti").unionByName(new)


def analysis_audit(before: DataFrame, after: DataFrame, actor: str, at: Column) -> DataFrame:
    """An audit row for each analysis that became done, with its number as meta."""
    running = before.filter("status = 'processing'").select("analysis_id")
    done = after.filter("status = 'done'").join(running, "analysis_id", "left_semi")
    return done.select(*audit_event(F.col(actor), ANALYSE, "Tender", F.col("record_id"), F.struct(F.col("analysis_id").alias("analysisId")), at))
