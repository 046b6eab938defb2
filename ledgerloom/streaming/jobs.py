"""File states driven by jobs: first as functions of tables, then as a stream of job files.

A job is (job_id, name, file_id). tender.fileRegistered moves a stored file to registration_done and pending; tender.extractText extracts a
registered file unless it is done; tender.parse and tender.aiAnalyze change nothing; a job of another name is refused. One
table row never stops a batch: what goes wrong is that file's outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.relations import first_per_key
from ledgerloom.operators.writes import update_by_key
from ledgerloom.sources.extraction import outcome_columns

REGISTER, EXTRACT, STUBS = "tender.fileRegistered", "tender.extractText", ("tender.parse", "tender.aiAnalyze")
JOB = "job_id string, name string, file_id string"
Extractor = Callable[[DataFrame], DataFrame]


def job_result(name: Column, file_id: Column, found: Column, file_status: Column, extraction_status: Column) -> Column:
    """What becomes of a job, by the rules in their order."""
    known = name.isin(REGISTER, EXTRACT, *STUBS)
    return (
        F.when(~known, "unknown_job")
        .when(name.isin(*STUBS), "ok")
        .when(file_id.isNull() | (file_id == ""), "missing_file_id")
        .when(~found, "file_not_found")
        .when((name == REGISTER) & (file_status != "stored"), "unexpected_status")
        .when((name == EXTRACT) & (file_status != "registration_done"), "unexpected_file_status")
        .when((name == EXTRACT) & (extraction_status == "done"), "skipped")
        .otherwise("ok")
    )


def route(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Each job with its result against the files' states."""
    states = files.select(F.col("file_id").alias("__id"), "file_status", "extraction_status")
    joined = jobs.join(states, jobs.file_id == states["__id"], "left")
    result = job_result(F.col("name"), F.col("file_id"), F.col("__id").isNotNull(), F.col("file_status"), F.col("extraction_status"))
    return joined.select(*jobs.columns, result.alias("result"))


def asked_files(jobs: DataFrame) -> DataFrame:
    """(file_id, to_register, to_extract): one row for each file that a batch names, however often."""
    named = jobs.filter(F.col("name").isin(REGISTER, EXTRACT) & (F.coalesce("file_id", F.lit("")) != ""))
    return named.groupBy("file_id").agg(F.bool_or(F.col("name") == REGISTER).alias("to_register"), F.bool_or(F.col("name") == EXTRACT).alias("to_extract"))


#: Files to a task: what a join of them holds in memory, some 1 KB a file, doesn't grow with the table.
TASK_FILES = 250_000


def tasks_for(files: DataFrame) -> int:
    return 1 + files.count() // TASK_FILES


def _after(files: DataFrame, jobs: DataFrame, extractor: Extractor, at: Column, tasks: int, how: str) -> DataFrame:
    """Files met with a batch of jobs, as they are afterwards, and whether it changes them (__changed)."""
    met = files.repartition(tasks, "file_id").join(asked_files(jobs).repartition(tasks, "file_id"), "file_id", how)
    registers = F.coalesce(F.col("to_register") & (F.col("file_status") == "stored"), F.lit(False))
    note = F.concat(F.lit("registered_at="), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    known = F.coalesce("extraction_status", F.lit("none"))
    extracts = F.col("to_extract") & (F.col("file_status") == "registration_done") & (known != "done")
    after = met.withColumn("__changed", registers | F.coalesce(extracts, F.lit(False))).withColumns(
        {
            "file_status": F.when(registers, "registration_done").otherwise(F.col("file_status")),
            "registration_note": F.when(registers, note).otherwise(F.col("registration_note")),
        }
    )
    outcomes = extractor(after.filter("__changed").select(*files.columns)).select(F.col("file_id").alias("__id"), "kind", "text", "reason")
    done = after.select(*files.columns, "__changed").join(outcomes, F.col("file_id") == F.col("__id"), "left")
    kind = F.coalesce("kind", F.lit("error"))
    reason = F.when(F.col("kind").isNull(), "s3_download:object not found").otherwise(F.col("reason"))
    columns = {c: F.when(F.col("__changed"), new).otherwise(F.col(c)) for c, new in outcome_columns(kind, F.col("text"), reason, at).items()}
    return done.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in files.columns], "__changed")


def changed_files(files: DataFrame, jobs: DataFrame, extractor: Extractor, at: Column, tasks: int | None = None) -> DataFrame:
    """The rows of files that a batch of jobs changes, as they are afterwards: registrations first, then the extractions they bring on
    together with those asked for. The extractor gets the files to extract and gives (file_id, kind, text, reason)."""
    return _after(files, jobs, extractor, at, tasks or tasks_for(files), "inner").filter("__changed").drop("__changed")


def apply_jobs(files: DataFrame, jobs: DataFrame, extractor: Extractor, at: Column) -> DataFrame:
    """All files after a batch of jobs."""
    return _after(files, jobs, extractor, at, tasks_for(files), "left").drop("__changed")


def request_again(files: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Files with the named registered ones back to pending and their outcome cleared; others stay as they are."""
    chosen = files.filter("file_status = 'registration_done'").select("file_id").join(file_ids, "file_id", "left_semi")
    cleared = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in ("extracted_text", "extraction_error", "extracted_at")]
    return update_by_key(files, chosen.select("file_id", F.lit("pending").alias("extraction_status"), *cleared), "file_id")


def publish(spark: SparkSession, folder: str, jobs: DataFrame) -> None:
    """Jobs into the folder that the stream reads."""
    jobs.selectExpr("job_id", "name", "file_id").write.mode("append").json(folder)


class FileTable:
    """The files' states as Parquet folders of changed rows, one a batch; a file's newest row counts. A batch written again replaces itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, files: DataFrame) -> None:
        self.change(files, -1)

    def current(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The table, or what it was before a batch; only the files of those ids, which are looked up before anything is sorted."""
        rows = self.spark.read.parquet(self.folder)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        rows = rows if of is None else rows.join(of.select("file_id"), "file_id", "left_semi")
        return first_per_key(rows, "file_id", [F.desc("batch")]).drop("batch")

    def tasks(self) -> int:
        """For joins of any of its files, from the rows that are there, without reading them."""
        return tasks_for(self.spark.read.parquet(self.folder))

    def change(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")


def run_stream(spark: SparkSession, jobs: str, table: FileTable, checkpoint: str, extractor: Extractor, at: Column) -> StreamingQuery:
    """Everything in the job folder so far, as micro-batches over the file table; a later call goes on from there."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table.change(changed_files(table.current(before=batch_id, of=asked_files(batch)), batch, extractor, at, table.tasks()), batch_id)

    stream = spark.readStream.schema(JOB).json(jobs)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
