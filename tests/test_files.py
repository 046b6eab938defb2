"""Extraction under limits, file states, streams and bundles."""

import io
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import writes
from ledgerloom.plans.records import docx_bytes
from ledgerloom.sources import extraction, files
from ledgerloom.sources.settings import ExtractionLimits
from ledgerloom.streaming import jobs

SMALL = ExtractionLimits(text_max_chars=1000, zip_max_files=3, zip_max_total_bytes=20_000, zip_max_depth=2, zip_max_nest_level=1, zip_max_entry_bytes=9000)
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def xlsx():
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{SHEET}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="a"/><sheet name="Blank" r:id="b"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="A3" s="1"><v>45292</v></c><c r="B3" t="b"><v>1</v></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/_rels/workbook.xml.rels", links)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}"><si><t>a, "b"</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{SHEET}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{SHEET}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{SHEET}"><sheetData/></worksheet>')
    return out.getvalue()


DOC = docx_bytes("inside")
NESTED = archive(d_dot_docx=DOC)

CASES = [
    (archive(a_dot_docx=DOC, b_dot_txt="x"), "ok", "--- a.docx ---\ninside\n\n--- b.txt ---\n[skipped:unsupported_format]"),
    (archive(a_dot_docx=b"broken"), "ok", None),
    (archive(n_dot_zip=NESTED), "ok", "--- n.zip (nested zip) ---\n--- d.docx ---\ninside"),
    (archive(n_dot_zip=archive(m_dot_zip=NESTED)), "quarantined", "nested:n.zip:nested:m.zip:zip_nesting_too_deep:2>1"),
    (archive(n_dot_zip=b"no zip"), "error", None),
    (archive(a=b"", b=b"", c=b""), "ok", None),
    (archive(a=b"", b=b"", c=b"", d=b""), "quarantined", "zip_too_many_files:4>3"),
    (archive(a=b"x" * 9000), "ok", None),
    (archive(a=b"x" * 9001), "quarantined", "zip_entry_too_large:a:9001>9000"),
    (archive(a=b"x" * 9000, b=b"x" * 9000, c=b"x" * 2000), "ok", None),
    (archive(a=b"x" * 9000, b=b"x" * 9000, c=b"x" * 2001), "quarantined", "zip_total_uncompressed:20001>20000"),
    (archive(p__q__a_dot_docx=DOC), "ok", None),
    (archive(a_dot_docx=DOC, p__q__r__a_dot_txt=b""), "quarantined", "zip_path_too_deep:p/q/r/a.txt"),
    (archive(), "skipped", "zip_no_text"),
    (b"not a zip", "error", None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_archives(case):
    data, kind, told = CASES[case]
    found, text, reason = extraction.read_file("zip", data, SMALL)
    assert found == kind and (told is None or told == (text if kind == "ok" else reason))


def test_readers():
    assert extraction.read_file("spreadsheet", xlsx(), SMALL) == ("ok", '## One\n"a, ""b""",,2.5\n,,\n1/1/24,TRUE,', None)
    assert extraction.read_file("docx", docx_bytes(" \n "), SMALL) == ("skipped", None, "docx_empty")
    assert extraction.read_file("docx", docx_bytes("y" * 1001), SMALL)[1].startswith("y" * 1000 + "\n\n...")
    assert extraction.read_file("image", b"", SMALL) == ("skipped", None, "image_ocr_disabled")
    assert extraction.read_file("image", b"", replace(SMALL, ocr_enabled=True))[0] == "error"
    assert extraction.read_file("unknown", None, SMALL) == ("skipped", None, "unsupported_format")
    assert extraction.read_file("doc", b"", SMALL)[0] == "error"


def test_extraction_of_a_table_and_of_stored_objects(spark, tmp_path):
    rows = [("1", "a.DOCX", None, DOC), ("2", "b", "application/zip", NESTED), ("3", "c.zip", "", None), ("4", None, None, b"x")]
    got = {r.file_id: (r.format, r.kind) for r in extraction.extract(spark.createDataFrame(rows, "file_id string, original_name string, content_type string, content binary")).collect()}
    assert got == {"1": ("docx", "ok"), "2": ("zip", "ok"), "3": ("zip", "error"), "4": ("unknown", "skipped")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.docx").write_bytes(DOC)
    (tmp_path / "d" / "b.docx").write_bytes(b"")
    assert [bytes(r.content) for r in files.accepted_uploads(files.read_objects(spark, str(tmp_path / "d"))).collect()] == [DOC]


FILE = "file_id string, file_status string, registration_note string, extraction_status string, extracted_text string, extraction_error string, extracted_at timestamp_ntz"


def start(spark):
    rows = [("a", "stored"), ("b", "pending_upload"), ("c", "registration_done"), ("d", "registration_done")]
    states = {"c": "done", "d": "failed"}
    return spark.createDataFrame([(i, s, None, states.get(i, "none"), "old" if i == "c" else None, None, None) for i, s in rows], FILE)


def extractor(chosen):
    return chosen.filter("file_id <> 'd'").select("file_id", F.lit("ok").alias("kind"), F.lit("new").alias("text"), F.lit(None).cast("string").alias("reason"))


ASKED = [("1", jobs.REGISTER, "a"), ("2", jobs.REGISTER, "b"), ("3", jobs.EXTRACT, "c"), ("4", jobs.EXTRACT, "d"), ("5", "odd", "a"), ("6", jobs.EXTRACT, None), ("7", "tender.parse", None), ("8", jobs.EXTRACT, "z"), ("9", jobs.REGISTER, "a")]
def at():
    return F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")


def told(df):
    return sorted((r.file_id, r.file_status, r.extraction_status, r.extracted_text, r.extraction_error) for r in df.collect())


EXPECTED = [("a", "registration_done", "done", "new", None), ("b", "pending_upload", "none", None, None), ("c", "registration_done", "done", "old", None), ("d", "registration_done", "failed", None, "s3_download:object not found")]


def test_jobs_in_one_batch(spark):
    batch = spark.createDataFrame(ASKED, jobs.JOB)
    assert told(jobs.apply_jobs(start(spark), batch, extractor, at())) == EXPECTED
    results = {r.job_id: r.result for r in jobs.route(batch, start(spark)).collect()}
    assert results == {"1": "ok", "2": "unexpected_status", "3": "skipped", "4": "ok", "5": "unknown_job", "6": "missing_file_id", "7": "ok", "8": "file_not_found", "9": "ok"}


def test_stream_equals_batch_and_a_replay_changes_nothing(spark, tmp_path):
    table = jobs.FileTable(spark, str(tmp_path / "files"))
    table.create(start(spark))
    for part in (ASKED[:4], ASKED[4:]):
        jobs.publish(spark, str(tmp_path / "jobs"), spark.createDataFrame(part, jobs.JOB))
        jobs.run_stream(spark, str(tmp_path / "jobs"), table, str(tmp_path / "checkpoint"), extractor, at()).awaitTermination()
    assert told(table.current()) == EXPECTED
    again = spark.createDataFrame(ASKED[:4], jobs.JOB)
    table.change(jobs.changed_files(table.current(before=0), again, extractor, at()), 0)  # the first batch once more
    assert told(table.current()) == EXPECTED


def test_request_again_clears_registered_files_only(spark):
    ids = spark.createDataFrame([("c",), ("b",)], "file_id string")
    again = {r.file_id: (r.extraction_status, r.extracted_text) for r in jobs.request_again(start(spark), ids).collect()}
    assert again["c"] == ("pending", None) and again["b"] == ("none", None) and again["d"] == ("failed", None)


def test_replacing_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    new, parents = spark.createDataFrame([(1, "x")], "p int, v string"), spark.createDataFrame([(1,)], "p int")
    once = writes.replace_children(old, new, parents, "p")
    assert sorted(once.collect()) == sorted(writes.replace_children(once, new, parents, "p").collect()) == [(1, "x"), (2, "c")]


def test_export_bundle(spark):
    records = spark.createDataFrame([("r1", "T", None, "manual", None), ("r2", "U", "d", "url", "http://x.y")], "id string, title string, description string, source_type string, source_url string")
    analyses = spark.createDataFrame([("r1", "a1", "done", 1), ("r1", "a2", "done", 2), ("r1", "a3", "failed", 3)], "record_id string, analysis_id string, status string, created_at int")
    rows = spark.createDataFrame([("a2", 1, "k2"), ("a2", 0, "k1"), ("a1", 0, "old")], "analysis_id string, sort_order int, field_key string")
    drafts = spark.createDataFrame([("r1", "body"), ("r2", "")], "record_id string, body string")
    listed = spark.createDataFrame([("r1", "i", "t", True, "ok", None)], "record_id string, item_key string, title string, required boolean, status string, note string")
    stored = [("r1", "f1", "a b.pdf", "done", 1, "first"), ("r1", "f2", "a?b.pdf", "done", 2, "second"), ("r1", "f3", "c", "failed", 3, None)]
    texts = spark.createDataFrame(stored, "record_id string, file_id string, original_name string, extraction_status string, created_at int, extracted_text string")
    bundles = files.zip_bundles(files.bundle_entries(records, analyses, rows, drafts, listed, texts))
    got = {(r.id, r.path): r.content for r in files.unpack(bundles).collect()}
    assert set(got) == {("r1", p) for p in ("tender.json", "analysis.json", "draft.txt", "checklist.json", "extracted/a_b.pdf.txt")} | {("r2", "tender.json")}
    assert got[("r1", "extracted/a_b.pdf.txt")] == "second" and '"a2"' in got[("r1", "analysis.json")] and got[("r1", "analysis.json")].index("k1") < got[("r1", "analysis.json")].index("k2")
    assert got[("r1", "tender.json")] == '{\n  "id": "r1",\n  "title": "T",\n  "description": null,\n  "source_type": "manual",\n  "source_url": null\n}'
    assert got[("r1", "checklist.json")].startswith('[\n  {\n    "item_key": "i",')


def test_text_boxes_and_many_styles():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    box = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>out</w:t><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:r></w:p></w:body></w:document>'
    assert extraction.read_docx(archive(word__document_dot_xml=box), SMALL) == ("ok", "out\n\nbox", None)
    with zipfile.ZipFile(io.BytesIO(xlsx())) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{SHEET}"><cellXfs>{"<xf numFmtId='0'/>" * 4999}<xf numFmtId="14"/></cellXfs></styleSheet>'.encode()
    parts["xl/worksheets/s1.xml"] = parts["xl/worksheets/s1.xml"].replace(b's="1"', b's="4999"')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    assert extraction.read_spreadsheet(out.getvalue(), replace(SMALL, zip_max_total_bytes=10**6))[1].endswith("1/1/24,TRUE,")


def test_append_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for part in (rows, rows):
        files.append(part, f"{tmp_path}/t", ["k"])
        files.write_json(part, f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/t").filter("k = 1").count() == 2
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"k":1,"v":"a"}'] * 2 + ['{"k":2,"v":null}'] * 2


def test_objects_are_written_whole_under_their_keys(spark, tmp_path):
    rows = [("a/b.txt", b"one"), ("a/c d/e", b"\x00\xff"), ("f", None), ("g/empty", b"")]
    objects = spark.createDataFrame(rows, "storage_key string, content binary")
    receipts = files.write_objects(objects, f"file://{tmp_path}/o", f"{tmp_path}/r1")
    assert {r.storage_key: r.size_bytes for r in receipts.collect()} == {"a/b.txt": 3, "a/c d/e": 2, "f": 0, "g/empty": 0}
    for key, content in rows:
        assert (tmp_path / "o" / key).read_bytes() == (content or b"")
    again = spark.createDataFrame([("a/b.txt", b"two!")], "storage_key string, content binary")
    files.write_objects(again, f"file://{tmp_path}/o", f"{tmp_path}/r2")
    assert (tmp_path / "o/a/b.txt").read_bytes() == b"two!" and not list((tmp_path / "o").rglob("*.part"))
    for n, bad in enumerate([("a", "a"), (None, "b"), ("", "b"), ("../x", "b"), ("/x", "b"), ("x/", "b")]):
        twice = spark.createDataFrame([(k, b"x") for k in bad], "storage_key string, content binary")
        with pytest.raises(ValueError):
            files.write_objects(twice, f"file://{tmp_path}/o", f"{tmp_path}/bad{n}")
    assert files.write_objects(objects.filter("false"), f"file://{tmp_path}/o", f"{tmp_path}/r3").count() == 0


def test_tasks_of_a_batch_grow_with_the_files(spark, monkeypatch):
    """Tasks as AQE merged them held 2,684 MB each for 9 million files."""
    monkeypatch.setattr(jobs, "TASK_FILES", 10)
    columns = start(spark).columns
    rows = start(spark).limit(1).drop("file_id").crossJoin(spark.range(95).select(F.col("id").cast("string").alias("file_id"))).select(*columns)
    asked = rows.select(F.col("file_id").alias("job_id"), F.lit(jobs.REGISTER).alias("name"), "file_id")
    after = jobs.apply_jobs(rows, asked, extractor, at())
    assert after.rdd.getNumPartitions() == 10 and after.count() == 95


def test_objects_are_fetched_by_key_without_a_list(spark, tmp_path, monkeypatch):
    objects = spark.createDataFrame([(f"a/{i % 3}/o {i}%20é", b"x" * i) for i in range(40)], "storage_key string, content binary")
    receipts = files.write_objects(objects, f"file://{tmp_path}/o", f"{tmp_path}/r")
    gone = spark.createDataFrame([("a/0/none",)], "storage_key string")
    monkeypatch.setattr(files, "_HELD", 100)
    found = {r.storage_key: None if r.content is None else bytes(r.content) for r in files.fetch_objects(receipts.select("storage_key").union(gone), f"file://{tmp_path}/o").collect()}
    assert found == {r.storage_key: bytes(r.content) for r in objects.collect()} | {"a/0/none": None}
