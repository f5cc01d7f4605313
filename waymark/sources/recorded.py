"""Recorded JSON responses: no network, the shape of the live services. A response is a line: key, status, body.

``keyed`` reads files that lie in folders ``key=<key>``, as Spark's ``partitionBy("key")`` writes them, with Spark's own
reader: a filter on the key chooses folders before any file is opened, in whatever store Spark reads.

``spark.read.format("recorded")`` is a Python source over files in any folders; files are put into tasks by size.
``spark.readStream.format("recorded")`` reads the files of a poll in the order of their names: a poll writes a file
whose name is greater than all before. An offset is the last name that was read, so a batch that runs again reads the
same files, and one run of ``availableNow`` takes one batch: what has come until then, or what a failed batch was to
read. Their ``path`` is a folder or file that every machine sees, by any scheme of ``pyarrow.fs``; a bare path is a
mounted folder. Filters aren't pushed into them: Spark 4.1 keeps what one query of a loaded table has pushed for its next
query too, which then lacks rows.

A body is null unless its status is 200.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of the files that one task reads.
TASK_BYTES = 32 << 20


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """``key, status, body`` of the responses under ``path/key=<key>``; lines that are no JSON have neither status nor body."""
    lines = spark.read.schema("value string, key string").text(path)
    answer = F.try_parse_json("value")
    status = F.try_variant_get(answer, "$.status", "int")
    body = F.when(status == 200, F.to_json(F.try_variant_get(answer, "$.body", "variant")))
    return lines.where(F.trim("value") != "").select("key", status.alias("status"), body.alias("body"))


class RecordedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "key string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Poll(self.options["path"])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """The files of a path in order of their names, without hidden ones and marks of success."""
    store, root = _open(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    return sorted((f for f in found if f.size and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _rows(root: str, paths: Iterable[str]) -> Iterator[tuple]:
    store, _ = _open(root)
    for path in paths:
        with store.open_input_stream(path) as raw:
            rest = b""
            while block := raw.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from _parsed(lines)
            yield from _parsed([rest])


def _parsed(lines: list[bytes]) -> Iterator[tuple]:
    for line in lines:
        if line.strip():
            r = json.loads(line)
            ok = r.get("status") == 200
            yield r.get("key"), r.get("status"), json.dumps(r.get("body")) if ok else None


class _Reader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[InputPartition]:
        out: list[tuple[str, ...]] = []
        paths: list[str] = []
        size = 0
        for f in _files(self.path):
            if paths and size + f.size > self.task_bytes:
                out.append(tuple(paths))
                paths, size = [], 0
            paths.append(f.path)
            size += f.size
        return [Files(p) for p in [*out, *([tuple(paths)] if paths else [])]] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition.paths)


class _Poll(DataSourceStreamReader):
    """Files by name; one that comes later under a smaller name is not seen, as with any log."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"last": files[-1].path if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Files((f.path,)) for f in _files(self.path) if start["last"] < f.path <= end["last"]]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition.paths)

    def commit(self, end: dict) -> None:
        """Files stay: they are the record from which a batch is read again."""


def facility_count(body: Column) -> Column:
    """The nested total of a count response."""
    return F.try_variant_get(F.try_parse_json(body), "$.METADATA.RESULTS.TOTAL_COUNT", "int")


FACILITY = (
    "struct<FacilityID:string,FacilityName:string,FacilityTypeDescription:string,Reservable:boolean,FacilityPhone:string,FacilityDescription:string,"
    "RECAREA:array<struct<RecAreaName:string>>,MEDIA:array<struct<MediaType:string,URL:string,Title:string>>>"
)


def facilities(body: Column) -> Column:
    """The candidate array of a facility response; empty if the body or the array is missing."""
    parsed = F.from_json(body, f"struct<RECDATA:array<{FACILITY}>>")
    return F.coalesce(parsed["RECDATA"], F.array().cast(f"array<{FACILITY}>"))
