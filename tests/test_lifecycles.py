"""Life cycles of records, files and analyses, case by case."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import lifecycles

FILES = "file_id string, file_status string, extraction_status string, extracted_text string, extraction_error string, extracted_at timestamp"
NOW = dt.datetime(2024, 5, 1)


def test_activation(spark):
    records = spark.createDataFrame([(1, "draft", "a"), (2, "archived", "b"), (3, "draft", "c"), (4, None, "d"), (None, "draft", "e")], "id int, status string, name string")
    uploads = spark.createDataFrame([(1, True), (1, True), (2, True), (3, False), (4, None), (9, True), (None, True)], "record int, stored boolean")
    got = lifecycles.activate(records, uploads, "id", "record", F.coalesce("stored", F.lit(False)))
    assert sorted((r.name, r.status) for r in got.collect() if r.status) == [("a", "active"), ("b", "active"), ("c", "draft"), ("e", "draft")]
    assert got.columns == records.columns and got.count() == 5


def test_reextraction(spark):
    files = spark.createDataFrame(
        [("r", "registration_done", "done", "text", None, NOW), ("s", "stored", "none", None, None, None), ("f", "registration_done", "failed", None, "why", NOW), ("n", None, "none", None, None, None)], FILES
    )
    asked = spark.createDataFrame([("r", "1", "ann"), ("r", "2", "bob"), ("s", "3", "ann"), ("x", "4", "ann"), (None, "5", "ann"), ("n", "6", "ann")], "file_id string, request_id string, actor string")
    judged = lifecycles.judge_reextraction(files, asked)
    assert {r.request_id: r.result for r in judged.collect()} == {"1": "ok", "2": "ok", "3": "bad_file_status", "4": "not_found", "5": "not_found", "6": "bad_file_status"}
    after, jobs, audit = lifecycles.reextract(files, judged, "actor", F.lit(NOW))
    told = {r.file_id: (r.extraction_status, r.extracted_text, r.extraction_error, r.extracted_at) for r in after.collect()}
    assert told == {"r": ("pending", None, None, None), "s": ("none", None, None, None), "f": ("failed", None, "why", NOW), "n": ("none", None, None, None)}
    assert sorted(tuple(r) for r in jobs.collect()) == [("1", "tender.extractText", "r"), ("2", "tender.extractText", "r")]
    assert sorted((r.actor_user_id, r.action, r.target_type, r.target_id, r.meta) for r in audit.collect()) == [
        (a, "admin.reextract_tender_file", "TenderFile", "r", None) for a in ("ann", "bob")
    ]


R = "r struct<status:string,summary:string,fields:array<struct<key:string,label:string,value:string,confidence:double>>>"


def test_analyses(spark):
    corpora = spark.createDataFrame([("t", i, c) for i, c in enumerate(["text", " \n\t", None, "more", "x", "y"])], "record_id string, analysis_id int, corpus string")
    begun = lifecycles.start_analyses(corpora)
    assert {r.analysis_id: r.status for r in begun.collect()} == {0: "processing", 1: "no_extracted_text", 2: "no_extracted_text", 3: "processing", 4: "processing", 5: "processing"}
    none = F.lit(None).cast("string")
    before = begun.select("*", none.alias("summary"), none.alias("raw_output"), none.alias("model"), F.lit("old").alias("error"))
    field = ("k", "l", "v", 0.5)
    outcomes = spark.createDataFrame(
        [
            (0, "out", "m", None, ("ok", "sum", [field, ("k2", "l2", "v2", 1.0)])),
            (3, "bad", "m", None, ("schema_mismatch", None, None)),
            (4, None, None, "Error: timeout", None),
            (1, "out", "m", None, ("ok", "too late", [field])),
        ],
        f"analysis_id int, raw_output string, model string, error string, {R}",
    )
    after = lifecycles.finish_analyses(before, outcomes)
    assert {r.analysis_id: (r.status, r.summary, r.raw_output, r.model, r.error) for r in after.collect()} == {
        0: ("done", "sum", "out", "m", None),
        1: ("no_extracted_text", None, None, None, "old"),
        2: ("no_extracted_text", None, None, None, "old"),
        3: ("failed", None, "bad", "m", "schema_mismatch"),
        4: ("failed", None, None, None, "Error: timeout"),
        5: ("processing", None, None, None, "old"),
    }
    old = spark.createDataFrame([(i, "old", "l", "v", 0.1, 0) for i in (0, 1, 3, 5)], "analysis_id int, field_key string, field_label string, value_text string, confidence double, sort_order int")
    got = sorted((r.analysis_id, r.sort_order, r.field_key) for r in lifecycles.replaced_fields(old, before, outcomes).collect())
    assert got == [(0, 0, "k"), (0, 1, "k2"), (1, 0, "old"), (3, 0, "old"), (5, 0, "old")]
    audit = lifecycles.analysis_audit(before, after, "record_id", F.lit(NOW)).collect()
    assert [(r.actor_user_id, r.action, r.target_type, r.target_id, r.meta) for r in audit] == [("t", "tender.ai_analyze", "Tender", "t", '{"analysisId":0}')]


def test_a_finished_analysis_stays_as_it_is(spark):
    done = spark.createDataFrame([("t", 1, "done", "s", "o", "m", None)], "record_id string, analysis_id int, status string, summary string, raw_output string, model string, error string")
    late = spark.createDataFrame([(1, None, None, "Error: late", None)], f"analysis_id int, raw_output string, model string, error string, {R}")
    assert lifecycles.finish_analyses(done, late).collect() == done.collect()


def test_retention(spark):
    rows = [(i, "q", "completed" if i % 2 else "failed", dt.datetime(2024, 1, 1, i)) for i in range(20)]
    rows += [(50, "q", "completed", None), (51, "q", "waiting", None), (52, None, None, None), (53, "r", "completed", NOW), (20, "q", "failed", dt.datetime(2024, 1, 1, 18))]
    jobs = spark.createDataFrame(rows, "job_id int, queue string, state string, finished_at timestamp")
    kept = sorted(r.job_id for r in lifecycles.retained_jobs(jobs, completed=3, failed=2).collect())
    assert kept == [15, 17, 18, 19, 20, 51, 52, 53]
    assert lifecycles.retained_jobs(jobs.filter("false")).count() == 0
