"""A queue of jobs in a shared folder, as a Python data source for batches and streams.

`data` holds a file of JSON lines for each task of a write, `log` a numbered entry for each write that succeeded: the files and how many jobs
each has. A file that no entry names doesn't count, so a failed or repeated task leaves nothing behind that a reader sees. An entry takes its
number by being created under it, which only one writer can; the others go on to the next number. A stream's write carries the batch's tag,
and a tag that is in the log already isn't entered again.

A stream's offset is the number of entries read. Each file of the entries between two offsets is a partition. When a stream says that it is
done with an offset, entries before it may go, but for the last `retain` ones (all stay where the option isn't given).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.session import pickled_by_value

FORMAT = "job_queue"
SCHEMA = "job_id string, name string, file_id string"
_PIECE = 1 << 20


@dataclass
class JobFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str
    jobs: int


class _Folder:
    """The files of a queue, by pyarrow's filesystems."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def names(self, part: str) -> list[str]:
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{part}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()

    def write(self, path: str, data: bytes) -> None:
        self.files.create_dir(f"{self.root}/{path.rsplit('/', 1)[0]}", recursive=True)
        with self.files.open_output_stream(f"{self.root}/{path}") as f:
            f.write(data)

    def claim(self, path: str, data: bytes) -> bool:
        """Whether the file was created by this call: written beside, then moved to a place where nothing is yet."""
        from pyarrow import fs

        spare = f"{path}.{uuid.uuid4().hex}"
        self.write(spare, data)
        place = f"{self.root}/{path}"
        try:
            if isinstance(self.files, fs.LocalFileSystem):
                import os

                os.link(f"{self.root}/{spare}", place)
            elif self.files.get_file_info(place).type != fs.FileType.NotFound:
                return False
            else:
                self.files.move(f"{self.root}/{spare}", place)
            return True
        except (FileExistsError, OSError):
            return False
        finally:
            self.remove(spare)

    def remove(self, path: str) -> None:
        try:
            self.files.delete_file(f"{self.root}/{path}")
        except FileNotFoundError:
            pass

    def entries(self) -> list[dict]:
        """The log from the oldest entry that is left."""
        return [json.loads(self.read(f"log/{n}")) | {"number": int(n)} for n in self.names("log") if n.isdigit()]

    def next_number(self) -> int:
        numbers = [int(n) for n in self.names("log") if n.isdigit()]
        return numbers[-1] + 1 if numbers else 0

    def enter(self, messages: list[Written | None], tag: str | None) -> None:
        files = [{"path": m.path, "jobs": m.jobs} for m in messages if m is not None and m.jobs]
        if tag is not None and any(e.get("tag") == tag for e in self.entries()):
            self.drop(messages)
            return
        while not self.claim(f"log/{self.next_number():012d}", json.dumps({"files": files, "tag": tag}).encode()):
            pass

    def drop(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                self.remove(m.path)


def _lines(folder: _Folder, path: str) -> Iterator[bytes]:
    """A file's lines, of which a piece is held at a time."""
    left = b""
    with folder.files.open_input_stream(f"{folder.root}/{path}") as f:
        while piece := f.read(_PIECE):
            *whole, left = (left + piece).split(b"\n")
            yield from whole
    if left:
        yield left


def _read(uri: str, columns: list[str], path: str) -> Iterator[tuple]:
    for line in _lines(_Folder(uri), path):
        job = json.loads(line)
        yield tuple(job.get(c) for c in columns)


def _write(uri: str, rows: Iterator) -> Written:
    """A task's jobs as one file, written as they come; a task that fails takes its file away again."""
    path, jobs = f"data/{uuid.uuid4().hex}.jsonl", 0
    first = next(rows, None)
    if first is None:
        return Written(path, jobs)
    folder = _Folder(uri)
    folder.files.create_dir(f"{folder.root}/data", recursive=True)
    try:
        with folder.files.open_output_stream(f"{folder.root}/{path}", buffer_size=_PIECE) as f:
            for row in chain([first], rows):
                f.write(json.dumps(row.asDict(), default=str).encode() + b"\n")
                jobs += 1
    except BaseException:
        folder.remove(path)
        raise
    return Written(path, jobs)


class _BatchReader(DataSourceReader):
    def __init__(self, uri: str, columns: list[str]):
        self.uri, self.columns = uri, columns

    def partitions(self) -> list[JobFile]:
        return [JobFile(f["path"]) for e in _Folder(self.uri).entries() for f in e["files"]]

    def read(self, partition: JobFile) -> Iterator[tuple]:
        return _read(self.uri, self.columns, partition.path) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, columns: list[str], retain: int | None):
        self.uri, self.columns, self.retain = uri, columns, retain

    def initialOffset(self) -> dict:
        entries = _Folder(self.uri).names("log")
        return {"entry": int(entries[0]) if entries else 0}

    def latestOffset(self) -> dict:
        return {"entry": _Folder(self.uri).next_number()}

    def partitions(self, start: dict, end: dict) -> list[JobFile]:
        found = [e for e in _Folder(self.uri).entries() if start["entry"] <= e["number"] < end["entry"]]
        if len(found) != end["entry"] - start["entry"]:
            raise ValueError(f"entries of the queue between {start['entry']} and {end['entry']} are gone")
        return [JobFile(f["path"]) for e in found for f in e["files"]]

    def read(self, partition: JobFile) -> Iterator[tuple]:
        return _read(self.uri, self.columns, partition.path)

    def commit(self, end: dict) -> None:
        """Entries before the offset go, but for the last `retain` ones; their files first, so that no entry names a missing file for long."""
        if self.retain is None:
            return
        folder = _Folder(self.uri)
        for e in folder.entries():
            if e["number"] < end["entry"] - self.retain and e["number"] < folder.next_number() - 1:
                for f in e["files"]:
                    folder.remove(f["path"])
                folder.remove(f"log/{e['number']:012d}")


class _BatchWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator) -> Written:
        return _write(self.uri, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _Folder(self.uri).enter(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        _Folder(self.uri).drop(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, uri: str, tag: str):
        self.uri, self.tag = uri, tag

    def write(self, iterator: Iterator) -> Written:
        return _write(self.uri, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _Folder(self.uri).enter(messages, f"{self.tag}/{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _Folder(self.uri).drop(messages)


class JobQueue(DataSource):
    """format("job_queue"), options path and retain, and for a stream's write tag, which tells its batches from another stream's."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options["path"], schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        retain = self.options.get("retain")
        return _StreamReader(self.options["path"], schema.names, None if retain is None else int(retain))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a queue is only appended to")
        return _BatchWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"], self.options["tag"])


def register_queue(spark: SparkSession) -> None:
    with pickled_by_value(__name__):
        spark.dataSource.register(JobQueue)
