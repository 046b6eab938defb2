"""File sources and sinks: stored objects in, export bundles and JSON out."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.contracts import pretty_json, valid_upload
from ledgerloom.functions.text import safe_name

RECORD_FILE_LIMIT = 50 * 1024 * 1024
DOCUMENT_FILE_LIMIT = 25 * 1024 * 1024
#: Bytes of objects that a task gathers before it hands them on.
_HELD = 8 * 1024 * 1024


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(storage_key, size_bytes, content) of stored objects; the size filter can prune before content is read.

    The driver lists the folder, some 3 KB an object: for uploads of one batch; where the keys are known, fetch_objects."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("storage_key"), F.col("length").alias("size_bytes"), "content")


def _put(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        keys, contents = batch.column(0).to_pylist(), batch.column(1)
        sizes, digests = [], []
        for key, content in zip(keys, contents, strict=True):
            data = content.as_py() or b""
            place = f"{root}/{key}"
            files.create_dir(place.rsplit("/", 1)[0], recursive=True)
            spare = f"{place}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(spare) as out:
                out.write(data)
            files.move(spare, place)
            sizes.append(len(data))
            digests.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["storage_key", "size_bytes", "content_sha256"])


def write_objects(objects: DataFrame, folder: str, receipts: str) -> DataFrame:
    """The bytes of objects (storage_key, content) under their keys in a folder, given as a URI; a receipt (storage_key, size_bytes,
    content_sha256) of each, which are written to a folder of their own and returned.

    Each object is written beside its place and moved there whole, so a reader sees all of it or nothing, and a task that runs again puts
    the same bytes there. Null content is empty. A key that is null, empty, named twice or leads out of the folder is an error.
    """
    key = F.col("storage_key")
    bad = key.isNull() | (key == "") | key.startswith("/") | key.endswith("/") | F.array_contains(F.split(key, "/"), "..")
    wrong = objects.groupBy("storage_key").agg(F.count("*").alias("n")).filter(bad | (F.col("n") > 1)).select("storage_key").limit(3).collect()
    if wrong:
        raise ValueError(f"objects without a place of their own, as {[r.storage_key for r in wrong]}")
    rows = objects.select("storage_key", F.col("content").cast("binary"))
    rows.mapInArrow(lambda batches: _put(batches, folder), "storage_key string, size_bytes long, content_sha256 string").write.parquet(receipts)
    return objects.sparkSession.read.parquet(receipts)


def _get(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)

    def told(keys: list[str], found: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], ["storage_key", "content"])

    for batch in batches:
        keys, found, held = [], [], 0
        for key in batch.column(0).to_pylist():
            try:
                with files.open_input_stream(f"{root}/{key}") as f:
                    content = f.read()
            except FileNotFoundError:
                content = None
            keys.append(key)
            found.append(content)
            held += len(content or b"")
            if held > _HELD:
                yield told(keys, found)
                keys, found, held = [], [], 0
        if keys:
            yield told(keys, found)


def fetch_objects(keys: DataFrame, folder: str) -> DataFrame:
    """(storage_key, content) of the objects that keys (storage_key) name in a folder, given as a URI; null content where none is there.

    Tasks open them by their keys, so that the driver needs no list of the folder.
    """
    return keys.select("storage_key").mapInArrow(lambda batches: _get(batches, folder), "storage_key string, content binary")


def accepted_uploads(objects: DataFrame, limit: int = RECORD_FILE_LIMIT) -> DataFrame:
    return objects.filter(valid_upload(F.col("size_bytes"), limit))


def bundle_entries(
    records: DataFrame, analyses: DataFrame, fields: DataFrame, drafts: DataFrame, checklist: DataFrame, files: DataFrame
) -> DataFrame:
    """(id, path, content) of each record's export: its JSON, the newest done analysis, draft, checklist and extracted texts.

    Absent analyses, empty drafts and empty checklists have no entry. Of two files whose safe names agree the later wins.
    """
    newest = analyses.filter("status = 'done'").groupBy(F.col("record_id").alias("id")).agg(F.max_by(F.struct(*analyses.columns), F.struct("created_at", "analysis_id")).alias("a"))
    nested = fields.groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("sort_order", *[c for c in fields.columns if c not in ("sort_order", "analysis_id")]))).alias("fields"))
    analysis = newest.join(nested, F.col("a.analysis_id") == nested.analysis_id, "left").select(
        "id",
        F.lit("analysis.json").alias("path"),
        pretty_json(F.struct(F.col("a.*"), F.coalesce("fields", F.array().cast(nested.schema["fields"].dataType)).alias("fields"))).alias("content"),
    )
    record = records.select("id", F.lit("tender.json").alias("path"), pretty_json(F.struct("id", "title", "description", "source_type", "source_url")).alias("content"))
    draft = drafts.filter("body <> ''").select(F.col("record_id").alias("id"), F.lit("draft.txt").alias("path"), F.col("body").alias("content"))
    items = checklist.groupBy(F.col("record_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("item_key", "title", "required", "status", "note"))).alias("items"))
    listed = items.select("id", F.lit("checklist.json").alias("path"), pretty_json(F.col("items")).alias("content"))
    path = F.concat(F.lit("extracted/"), safe_name(F.col("original_name"), 80), F.lit(".txt"))
    done = files.filter("extraction_status = 'done'").select(F.col("record_id").alias("id"), path.alias("path"), "created_at", "file_id", F.coalesce("extracted_text", F.lit("")).alias("content"))
    texts = done.groupBy("id", "path").agg(F.max_by("content", F.struct("created_at", "file_id")).alias("content"))
    return record.union(analysis).union(draft).union(listed).union(texts)


def zip_bundles(entries: DataFrame) -> DataFrame:
    """(id, filename, content): one ZIP archive per record; a record's entries meet in one task, as its file must."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for path, content in sorted(zip(rows["path"], rows["content"], strict=True)):
                archive.writestr(zipfile.ZipInfo(path), content)
        return pd.DataFrame({"id": [key[0]], "filename": [f"tender-{str(key[0])[:8]}-export.zip"], "content": [out.getvalue()]})

    return entries.groupBy("id").applyInPandas(pack, "id string, filename string, content binary")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Rows added to a Parquet table."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def unpack(bundles: DataFrame) -> DataFrame:
    """(id, path, content) of ZIP bundles, for reading them back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record, content in zip(batch["id"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows += [(record, name, archive.read(name).decode()) for name in archive.namelist()]
            yield pd.DataFrame(rows, columns=["id", "path", "content"])

    return bundles.select("id", "content").mapInPandas(run, "id string, path string, content string")


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
